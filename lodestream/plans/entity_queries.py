"""Queries on entities, events by pattern, theses, section diffs and the graph's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import entities as E, factors as A, filings as L, graph as G, linking as K, monitoring as M, publish as P, vectors as V
from .bind import table
from .claim_queries import ADOPTION, ASSERTIONS, _adoption, assertions
from .graph_queries import EDGES, edges
from .registry import query

_TYPE = "CASE c_custkey % 3 WHEN 0 THEN 'TICKER' WHEN 1 THEN 'COMPANY' ELSE 'PRODUCT' END"
_TEXT = "CASE c_custkey % 3 WHEN 0 THEN '$' || lower(c_mktsegment) WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN ' nation' || CAST(c_nationkey AS VARCHAR) ELSE c_name END ELSE c_mktsegment END"


def _entities(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(_TYPE).alias("type"), F.expr(_TEXT.replace("VARCHAR", "STRING")).alias("text"))


@query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE upper(c_name) END ELSE c_mktsegment END AS normalized FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entity_forms(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("normalized"))
    return E.normalized(_entities(spark, d), names).select("c_custkey", "normalized")


@query(f"SELECT c_custkey, round(CASE WHEN contains('automobile building chips', lower({_TEXT})) THEN 0.5 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 0.3 ELSE 0 END + CASE WHEN c_custkey % 3 = 2 THEN 0.2 ELSE 0 END, 4)::DOUBLE AS words, round(CASE WHEN c_custkey % 10 >= 5 THEN 0.6 * (c_custkey % 10) / 10.0 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 3 = 2 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS meaning FROM customer")
def entity_relevance(spark, d):
    k, e = F.col("c_custkey"), _entities(spark, d)
    return e.select("c_custkey", F.round(E.theme_relevance(F.col("text"), F.col("type"), k % 4 == 0, F.lit("Automobile Building chips")), 4).alias("words"), F.round(E.semantic_relevance((k % 10) / 10.0, F.col("type"), k % 4 == 0), 4).alias("meaning"))


#: Spans of a document by its id modulo 4, with what stays.
_SPANS = {
    0: ([(0, 4, 0.9, "A"), (2, 10, 0.8, "B")], ["B"]), 1: ([(0, 8, 0.9, "A"), (2, 6, 0.95, "B"), (20, 24, 0.5, "C")], ["A", "C"]),
    2: ([(0, 8, 0.3, "A"), (4, 9, 0.7, "B")], ["B"]), 3: ([(0, 3, 0.5, "A"), (5, 8, 0.6, "A"), (9, 12, 0.6, "D")], ["A", "D"]),
}


@query("SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 4 " + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in _SPANS.items()) + " END) AS normalized FROM customer")
def entity_overlaps(spark, d):
    rows = [(k, *x, "COMPANY") for k, v in _SPANS.items() for x in v[0]]
    spans = spark.createDataFrame(rows, "k long, start int, end int, confidence double, normalized string, type string")
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 4).alias("k")).join(F.broadcast(spans), "k").drop("k")  # a dozen rows
    return E.without_overlaps(e).select("doc_id", "normalized")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NVIDIA|lookup|0.95' WHEN 1 THEN 'NVIDIA|fuzzy|0.90' WHEN 2 THEN 'TSMC|lookup|0.95,INTEL|lookup|0.95' ELSE '' END AS found FROM customer")
def company_mentions(spark, d):
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Shares of Nvidia rose' WHEN 1 THEN 'the nvdia chips' WHEN 2 THEN 'Intel and TSMC' ELSE 'a plain text' END")
    found = table(spark, d, "customer").select("c_custkey", E.company_mentions({"nvidia": ("NVIDIA", "NVDA"), "tsmc": ("TSMC", "TSM"), "intel": ("INTEL", "INTC")})(text).alias("f"))
    return found.select("c_custkey", F.array_join(F.transform("f", lambda x: F.concat_ws("|", x["normalized"], x["source"], F.format_string("%.2f", F.floor(x["confidence"] * 100) / 100))), ",").alias("found"))


_TRI = "list_distinct(list_transform(range(1, len('  ' || lower({0}) || ' ') - 1), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query(f"""WITH m AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'customer' || CAST(c_custkey AS VARCHAR) ELSE c_mktsegment || 'S' END AS mention FROM customer), n AS (SELECT DISTINCT c_name AS name, c_nationkey AS concept FROM customer UNION SELECT DISTINCT c_mktsegment, 1000 FROM customer),
p AS (SELECT mention, concept, {_TRI.format('mention')} AS a, {_TRI.format('name')} AS b FROM m, n), s AS (SELECT mention, concept, max(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))) AS s FROM p GROUP BY 1, 2)
SELECT mention, round(max(s), 6) AS similarity, CASE WHEN count(*) = 1 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM s WHERE s >= 0.4 GROUP BY 1""")
def fuzzy_resolution(spark, d):
    c = table(spark, d, "customer")
    m = c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("customer"), F.col("c_custkey").cast("string"))).otherwise(F.concat("c_mktsegment", F.lit("S"))).alias("mention"))
    n = c.select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("concept")).union(c.select("c_mktsegment", F.lit(1000).cast("long")))
    return E.fuzzy_resolved(m, n).select("mention", F.round("similarity", 6).alias("similarity"), "confidence")


#: What is told of a part, by its number; A is the part's name with capitals, and every figure is its own.
_TOLD = [
    "A || ' raised wafer prices by ' || p_size || '% in Q' || (p_size % 4 + 1) || ' 2026'",
    "A || ' invests $' || p_size || ' million in new ' || lower(p_type) || ' capacity during H' || (p_size % 2 + 1) || ' 2027'",
    "A || ' has delayed the ' || p_name || ' to 20' || (p_size % 50 + 30)",
    "A || ' expects revenue of $' || p_size || ' billion'",
    "A || ' is launching the ' || p_name",
    "'Lead times for the ' || p_name || ' aside, ' || p_name || ' supply shortage goes on'",
    "A || ' held its annual board meeting in ' || p_type",
]
_TOLD_TEXT = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_TOLD)) + " END"
_NAMED = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


def _events_sql() -> str:
    own = "upper(string_split(p_name, ' ')[2])"
    # type, actor, action, object, time, quantity, the part's own ticker told, begin, end
    rows = [
        ("price_change", "a", "'raised'", "'wafer prices'", "'2026-Q' || (p_size % 4 + 1)", "p_size || '%'", "0", "length(x)"),
        ("capacity_expansion", "a", "'invests'", "'new ' || lower(p_type) || ' capacity'", "'2027-H' || (p_size % 2 + 1)", "'$' || p_size || ' million'", "0", "length(x)"),
        ("product_delay", "a", "'delayed'", "p_name", "'20' || (p_size % 50 + 30)", "NULL", "0", "length(x)"),
        ("guidance_change", "a", "'expects'", "'revenue'", "NULL", "'$' || p_size || ' billion'", "0", "length(x)"),
        ("product_launch", "a", "'launching'", "p_name", "NULL", "NULL", "0", "length(x)"),
        ("capacity_constraint", "NULL", "'supply shortage'", "p_name", "NULL", "NULL", "length(x) - length(p_name || ' supply shortage goes on')", "length(x) - length(' goes on')"),
    ]
    parts = []
    for k, (kind, actor, action, thing, time, amount, begin, end) in enumerate(rows):
        sure = f"0.7 + CASE WHEN {actor} IS NULL THEN 0 ELSE 0.1 END + 0.1 + CASE WHEN {amount} IS NULL THEN 0 ELSE 0.1 END"
        parts.append(f"SELECT p_partkey AS doc_id, '{kind}' AS event_type, {actor} AS actor, {action} AS action, {thing} AS object, {time} AS time_ref, {amount} AS quantity, {own} AS tickers, round({sure}, 4)::DOUBLE AS confidence, ({begin})::BIGINT AS span_start, ({end})::BIGINT AS span_end FROM t WHERE p_partkey % 7 = {k}")
    text = _TOLD_TEXT.replace("A ||", "a ||")
    return f"WITH n AS (SELECT *, {_NAMED} AS a FROM part), t AS (SELECT *, {text} AS x FROM n) " + " UNION ALL ".join(parts)


@query(_events_sql())
def pattern_events(spark, d):
    part = table(spark, d, "part").withColumn("A", F.initcap("p_name")).withColumn("text", F.expr(_TOLD_TEXT)).withColumn("own", F.array(F.upper(F.split("p_name", " ")[1]), F.lit("ABSENT")))
    out = E.pattern_events(part.select(F.col("p_partkey").alias("doc_id"), "text", "own"), {"NVDA"}, {}, tickers="own", year=F.lit(2026))
    return out.withColumns({"tickers": F.array_join("tickers", ","), "confidence": F.round("confidence", 4)})


@query("SELECT o_orderkey, o_orderkey % 4 > 0 AS changed, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS added_lines, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS removed_lines, round(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 4.0 / 6 WHEN 2 THEN 6.0 / 8 ELSE 4.0 / 5 END, 6)::DOUBLE AS ratio FROM orders")
def section_diffs(spark, d):
    k = F.col("o_orderkey") % 4
    base = F.concat_ws("\n", F.lit("one"), F.col("o_orderpriority"), F.lit("three"))
    target = F.when(k == 0, base).when(k == 1, F.concat_ws("\n", F.lit("one"), F.lit("new"), F.lit("three"))).when(k == 2, F.concat_ws("\n", F.lit("zero"), base, F.lit("four"))).otherwise(F.concat_ws("\n", F.lit("one"), F.lit("three")))
    out = table(spark, d, "orders").select("o_orderkey", L.section_diff(base, target).alias("x"))
    return out.select("o_orderkey", "x.changed", "x.added_lines", "x.removed_lines", F.round("x.ratio", 6).alias("ratio"))


@query(r"""WITH t AS (SELECT p_partkey, 'Revenue growth of ' || p_name || ' ' || repeat('word ', p_size) AS x FROM part), w AS (SELECT p_partkey, length(x) AS l, len(regexp_extract_all(x, '[\pL\pN_]+'))::DOUBLE AS n FROM t)
SELECT p_partkey, CASE WHEN l < 50 THEN 'too_short' ELSE '' END AS flags, CASE WHEN l < 50 THEN 0 ELSE round(least(10, 2 / n * 140.0), 2) END::DOUBLE AS evidence, CASE WHEN l < 50 THEN 0 ELSE round(least(10, 2 / n * 70.0), 2) END::DOUBLE AS reasoning FROM w""")
def thesis_scores(spark, d):
    x = F.concat(F.lit("Revenue growth of "), "p_name", F.lit(" "), F.expr("repeat('word ', p_size)"))
    t = table(spark, d, "part").select("p_partkey", S.thesis(x).alias("t"))
    return t.select("p_partkey", F.concat_ws(",", "t.flags").alias("flags"), "t.evidence", "t.reasoning")


@query("SELECT p_partkey, p_name || chr(10) || 'Keywords: ' || p_brand || ', ' || p_type || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Tickers: T' || CAST(p_size AS VARCHAR) || chr(10) ELSE '' END || 'Lifecycle: mature' || chr(10) || 'Documents: ' || CAST(p_size AS VARCHAR) AS text FROM part")
def thesis_texts(spark, d):
    none = F.expr("cast(array() as array<string>)")
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.thesis_text(F.col("p_name"), F.array("p_brand", "p_type"), F.when(size % 2 == 0, F.array(F.concat(F.lit("T"), size.cast("string")))).otherwise(none), none, F.lit("mature"), size).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'generic_alias' WHEN 1 THEN 'academic_institution_collision' WHEN 2 THEN '' ELSE 'academic_institution_collision' END AS risks, CASE c_custkey % 4 WHEN 0 THEN 0.35 WHEN 1 THEN 0.5 WHEN 2 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN c_custkey % 4 = 2 THEN 'accepted' ELSE 'needs_review' END AS review_status FROM customer")
def innovation_aliases(spark, d):
    k = F.col("c_custkey") % 4
    a = table(spark, d, "customer").select("c_custkey", F.when(k == 0, " Research Labs, Inc.").when(k == 1, "M.I.T. College").when(k == 2, F.concat("c_name", F.lit(" Corp."))).otherwise("Fraunhofer").alias("alias"), F.when(k == 3, "research_institution").otherwise("name").alias("alias_type"), F.lit(None).cast("double").alias("confidence"))
    return K.guarded_aliases(a).select("c_custkey", F.concat_ws(",", "risks").alias("risks"), "confidence", "review_status")


@query(f"""WITH {ASSERTIONS}, a AS (SELECT subject * 1000 + object * 10 + length(predicate) AS assertion_id, subject, object, CASE predicate WHEN 'supplies' THEN NULL ELSE predicate END AS relation, confidence, status FROM assertions),
old AS (SELECT assertion_id FROM a WHERE assertion_id % 2 = 0), new AS (SELECT * FROM a WHERE status IN ('active', 'disputed') AND confidence >= 0.3 AND relation IS NOT NULL)
SELECT assertion_id, 'new' AS origin FROM new UNION ALL SELECT assertion_id, 'old' FROM old WHERE assertion_id NOT IN (SELECT assertion_id FROM new) AND assertion_id NOT IN (SELECT assertion_id FROM a WHERE status = 'retracted')""")
def graph_sync(spark, d):
    a = assertions(spark, d).withColumn("assertion_id", F.col("subject") * 1000 + F.col("object") * 10 + F.length("predicate"))
    old = a.filter("assertion_id % 2 = 0").select(F.col("subject").alias("source"), F.col("object").alias("target"), F.lit("old").alias("relation"), "assertion_id", F.lit(-1.0).alias("confidence"))
    return G.synced_supports(a, old).select("assertion_id", F.when(F.col("confidence") < 0, "old").otherwise("new").alias("origin"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 3 > 0), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2) SELECT label, round(sum(m), 5) AS total FROM m GROUP BY 1")
def mean_pooled(spark, d):
    tokens = table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return V.mean_pooled(tokens, "label").select("label", F.round(F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""WITH e AS (SELECT event_id % 40 AS feed, ts AS seen, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'parse_failure' ELSE 'ok' END AS status FROM events), l AS (SELECT feed, arg_max(status, seen) AS status, max(seen) FILTER (status = 'ok') AS good FROM e GROUP BY 1)
SELECT l.feed, l.status, CASE WHEN l.status <> 'ok' THEN 'fault' END AS error, count(e.feed) AS failures FROM l LEFT JOIN e ON e.feed = l.feed AND e.status <> 'ok' AND (good IS NULL OR e.seen > good) GROUP BY l.feed, l.status""")
def feed_health(spark, d):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "parse_failure").otherwise("ok")
    e = table(spark, d, "events").select((F.col("event_id") % 40).alias("feed"), F.col("ts").alias("at"), status.alias("status")).withColumn("error", F.when(F.col("status") != "ok", "fault"))
    return M.feed_health(e)


@query("""WITH a AS (SELECT o_orderpriority AS f, o_orderdate::DATE AS d, o_totalprice AS v, o_orderkey AS seen FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderdate::DATE, o_totalprice + 1, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 > 0 AND o_orderpriority <> '5-LOW')
SELECT f AS factor_id, CAST(d AS VARCHAR) AS observation_date, round(arg_max(v, seen), 2) AS value, max(seen) AS fetched_at FROM a GROUP BY 1, 2""")
def factor_refresh(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("factor_id"), F.to_date("o_orderdate").alias("observation_date"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("fetched_at"))
    new = o.filter("fetched_at % 2 = 1").withColumns({"value": F.col("value") + 1, "observation_date": F.when(F.col("fetched_at") % 7 > 0, F.col("observation_date"))})
    out = A.refreshed(o.filter("fetched_at % 2 = 0"), new, o.filter("factor_id <> '5-LOW'").select("factor_id"))
    return out.select("factor_id", F.col("observation_date").cast("string").alias("observation_date"), F.round("value", 2).alias("value"), "fetched_at")


def _health(spark):
    return spark.createDataFrame([("filing", "ready"), ("structural", "warn"), ("narrative", "blocked")], "lane string, readiness string")


@query(f"WITH {ADOPTION} SELECT 'filing' AS lane, 'adoption' AS object_type, CAST(issuer AS VARCHAR) AS object_id, round(adoption, 6) AS score FROM adopted UNION ALL SELECT 'filing', 'divergence', CAST(n_nationkey AS VARCHAR), NULL FROM nation")
def filing_publication(spark, d):
    parts = {"adoption": _adoption(spark, d).select(F.col("issuer").alias("object_id"), F.round("adoption", 6).alias("score")), "divergence": table(spark, d, "nation").select(F.col("n_nationkey").alias("object_id"), "n_name")}
    return P.lane_publication("filing", _health(spark), parts).select("lane", "object_type", "object_id", F.get_json_object("payload", "$.score").cast("double").alias("score"))


@query(f"WITH {EDGES} SELECT 'structural' AS lane, CAST(source AS VARCHAR) || '-' || CAST(target AS VARCHAR) AS object_id, round(confidence, 6)::DOUBLE AS score, source FROM edges WHERE source <> target")
def structural_publication(spark, d):
    paths = edges(spark, d).filter("source <> target").select("source", F.lit(None).cast("int").alias("middle"), "target", F.col("confidence").alias("score"), "sign", F.lit(1).alias("hops"))
    told = G.path_explanations(paths).select(F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string")).alias("object_id"), "payload")
    out = P.lane_publication("structural", _health(spark), {"path": told})
    inner = F.get_json_object("payload", "$.payload")
    return out.select("lane", "object_id", F.round(F.get_json_object(inner, "$.path_score").cast("double"), 6).alias("score"), F.get_json_object(inner, "$.source_concept_id").cast("int").alias("source"))


@query("""SELECT 'narrative' AS lane, 'run' AS object_type, CAST(o_orderkey AS VARCHAR) AS object_id, round(o_totalprice, 2) AS score FROM orders
UNION ALL SELECT 'narrative', 'theme', CAST(o_custkey % 10 AS VARCHAR), round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey % 10""")
def narrative_publication(spark, d):
    """Two lanes of the same runs and roll-ups by theme; what lane may publish, orders tell: one without open orders is blocked."""
    o = table(spark, d, "orders")
    lanes = spark.createDataFrame([("narrative", "F"), ("blocked", "none")], "lane string, o_orderstatus string")
    health = lanes.join(o, "o_orderstatus", "left").groupBy("lane").agg(F.when(F.count("o_orderkey") > 0, "ready").otherwise("blocked").alias("readiness"))
    themes = o.groupBy((F.col("o_custkey") % 10).alias("object_id")).agg(F.sum("o_totalprice").alias("score"))
    parts = {"run": o.select(F.col("o_orderkey").alias("object_id"), F.col("o_totalprice").alias("score")), "theme": themes}
    out = P.lane_publication("narrative", health, parts).unionByName(P.lane_publication("blocked", health, parts))
    return out.select("lane", "object_type", "object_id", F.round(F.get_json_object("payload", "$.score").cast("double"), 2).alias("score"))
