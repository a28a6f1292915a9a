"""Text rules on texts of the tables, or on sentences that tell a row's own values; the SQL works the answers out from those."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts as P, text as T
from ..operators import listings as L
from ..sources import documents as D
from .bind import table
from .registry import query

_CONTENT = r"list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, round(len({_CONTENT}) / 200, 1)::DOUBLE AS minutes FROM documents")
def reading_minutes(spark, d):
    return table(spark, d, "documents").select("doc_id", D.read_minutes(F.col("text")).alias("minutes"))


#: How a customer's segment is told; T is its symbol, the segment's first four letters.
_MENTIONS = ["'buy $' || lower(T) || ' now'", "'NASDAQ: ' || T || ' up'", "initcap_(c_mktsegment) || ' (' || T || ') said (no)'", "lower(T) || ' is a word ' || c_custkey", "T || ' shares rose ' || c_nationkey || '%'", "'wafer ' || c_nationkey || ' of ' || c_name"]
_MENTION = "CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_MENTIONS)) + " END"


@query("WITH c AS (SELECT c_custkey, upper(substring(c_mktsegment, 1, 4)) AS t FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 6 IN (3, 5) THEN '' ELSE t END AS tickers, c_custkey % 6 <> 3 AS relevant FROM c")
def ticker_texts(spark, d):
    c = table(spark, d, "customer").withColumn("T", F.upper(F.substring("c_mktsegment", 1, 4)))
    universe = {r[0] for r in c.select("T").distinct().collect()}  # five segments
    rows = c.select("c_custkey", F.expr(_MENTION.replace("initcap_", "initcap")).alias("x")).withColumn("t", P.tickers(universe, {}, set())("x"))
    return rows.select("c_custkey", F.concat_ws(",", "t").alias("tickers"), P.relevant(F.col("x"), ["wafer"], F.col("t")).alias("relevant"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'rumor' WHEN 1 THEN 'guided' ELSE 'reported' END AS modality,
CASE p_partkey % 4 WHEN 0 THEN '20' || (p_size % 50 + 30) || '-Q' || (p_size % 4 + 1) WHEN 1 THEN (2000 + p_size) || '-Q3' WHEN 2 THEN '20' || (p_size % 50 + 30) || '-H' || (p_size % 2 + 1) END AS period FROM part""")
def part_marks(spark, d):
    told = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' will reportedly rise' WHEN 1 THEN p_name || ' expects more ' || p_type ELSE p_name || ' rose' END"
    when = "CASE p_partkey % 4 WHEN 0 THEN 'in Q' || (p_size % 4 + 1) || ' 20' || (p_size % 50 + 30) WHEN 1 THEN p_name || ' by the third quarter' WHEN 2 THEN 'H' || (p_size % 2 + 1) || ' of 20' || (p_size % 50 + 30) ELSE p_name END"
    return table(spark, d, "part").select("p_partkey", T.modality(F.expr(told)).alias("modality"), T.period_of(F.expr(when), 2000 + F.col("p_size")).alias("period"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label, translate(lower(trim(' ' || p_name || '-' || p_type)), ' -', '__') AS tag,
trim(regexp_replace(regexp_replace(lower(p_name || ', ' || p_type || CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Corporation' ELSE ' & Co' END), '\b(inc|incorporated|corp|corporation|co|company|ltd|llc)\b\.?', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS alias FROM part""")
def part_names(spark, d):
    legal = F.when(F.col("p_partkey") % 3 == 0, " Inc.").when(F.col("p_partkey") % 3 == 1, " Corporation").otherwise(" & Co")
    return table(spark, d, "part").select("p_partkey", T.humanized(F.translate("p_name", " ", "_")).alias("label"), T.factor_tag(F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type")).alias("tag"), T.innovation_alias(F.concat("p_name", F.lit(", "), "p_type", legal)).alias("alias"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 5 > 0 THEN event_type END AS relation, CASE WHEN event_type IN ('click', 'view') AND event_id % 5 > 0 THEN least(1.0, round(value, 3)) END::DOUBLE AS confidence FROM events""")
def event_verdicts(spark, d):
    """Answers in JSON with an event's type and value; every fifth gives its number as a text."""
    number = F.round("value", 3).cast("string")
    told = F.concat(F.lit('{"relation": "'), "event_type", F.lit('", "confidence": '), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number), F.lit("}"))
    v = table(spark, d, "events").select("event_id", L.verdict(told, ["click", "view"]).alias("v"))
    return v.select("event_id", "v.relation", "v.confidence")
