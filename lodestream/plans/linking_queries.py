"""Queries that resolve names and link patents, research, claims and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as L, market as K
from .bind import table
from .registry import query

_ALIASES = """aliases AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS alias, 'c' || CAST(c_nationkey AS VARCHAR) AS concept_id, c_custkey % 4 = 0 AS is_primary, CAST(0.40013 + (c_custkey % 60) / 100.0 AS DOUBLE) AS confidence, CASE c_custkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'accepted' END AS review_status FROM customer WHERE c_custkey % 7 <> 0)"""
_CANDIDATES = """found AS (SELECT * FROM (SELECT n.name, a.*, row_number() OVER (PARTITION BY name ORDER BY is_primary DESC, alias = name DESC, review_status = 'accepted' DESC, confidence DESC, concept_id) AS place FROM names n JOIN aliases a ON lower(a.alias) = lower(n.name) WHERE review_status <> 'rejected') WHERE place <= 10)"""
_SECURITIES = "securities AS (SELECT DISTINCT 'c' || CAST(c_nationkey AS VARCHAR) AS concept_id, 's' || CAST(c_nationkey % 6 AS VARCHAR) AS security_id FROM customer)"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")


def _aliases(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "pending").otherwise("accepted")
    return c.select(F.when(k % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("alias"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("concept_id"), (k % 4 == 0).alias("is_primary"), (0.40013 + (k % 60) / 100.0).alias("confidence"), status.alias("review_status"), (k % 7 != 0).alias("is_active"))


def _securities(spark, d):
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(F.concat(F.lit("c"), n.cast("string")).alias("concept_id"), F.concat(F.lit("s"), (n % 6).cast("string")).alias("security_id")).distinct()


@query(f"WITH {_ALIASES}, names AS (SELECT unnest(['BUILDING', 'machinery', 'Nobody']) AS name), {_CANDIDATES} SELECT name, concept_id, round(confidence, 4) AS confidence, review_status, place FROM found")
def alias_candidates(spark, d):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("BUILDING", "machinery", "Nobody")])).alias("name"))
    return L.alias_candidates(names, _aliases(spark, d)).withColumn("confidence", F.round("confidence", 4))


_TYPE = "CASE WHEN p_type LIKE 'PROMO%' THEN 'tp' WHEN p_type LIKE 'STANDARD%' THEN 'ts' WHEN p_brand LIKE 'Brand#1%' THEN 'tb' END"


@query(f"""WITH {_ALIASES}, {_SECURITIES}, p AS (SELECT p_partkey AS record_id, p_size % 2 = 0 AS granted, {_TYPE} AS theme_id, unnest([upper(['{"', '".join(SEGMENTS)}'][CAST(p_partkey % 5 AS INTEGER) + 1]), lower(['{"', '".join(SEGMENTS)}'][CAST(p_size % 5 AS INTEGER) + 1])]) AS name FROM part WHERE p_partkey % 9 <> 0), names AS (SELECT DISTINCT name FROM p WHERE theme_id IS NOT NULL), {_CANDIDATES}
SELECT record_id, concept_id, security_id, theme_id, round(CASE WHEN granted THEN 0.95 ELSE 0.85 END::DOUBLE * confidence * CASE WHEN review_status = 'accepted' THEN 1.0 ELSE 0.75 END::DOUBLE, 4) AS confidence FROM p JOIN found USING (name) JOIN securities USING (concept_id) WHERE theme_id IS NOT NULL""")
def patent_links(spark, d):
    p = table(spark, d, "part")
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), (k % 5 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_partkey") % 9 != 0, F.lit("2024-01-01")).alias("event_date"), F.when(F.col("p_size") % 2 == 0, "grant").otherwise("application").alias("event_type"), F.array("p_type", "p_brand").alias("classes"), F.array(F.upper(pick(F.col("p_partkey"))), F.lower(pick(F.col("p_size")))).alias("assignees"))
    return L.patent_links(rows, {"PROMO": "tp", "standard": "ts", "Brand #1": "tb"}, _aliases(spark, d), _securities(spark, d))


@query(f"""WITH {_ALIASES}, {_SECURITIES}, p AS (SELECT p_partkey AS record_id, p_size % 2 = 0 AS open, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'economy') THEN 'cheap' END AS theme_id, ['{"', '".join(SEGMENTS)}'][CAST(p_partkey % 5 AS INTEGER) + 1] AS name FROM part), names AS (SELECT DISTINCT name FROM p WHERE theme_id IS NOT NULL), {_CANDIDATES}
SELECT record_id, concept_id, security_id, theme_id, round(CASE WHEN open THEN 0.9 ELSE 0.8 END::DOUBLE * confidence * CASE WHEN review_status = 'accepted' THEN 1.0 ELSE 0.75 END::DOUBLE, 4) AS confidence FROM p JOIN found USING (name) JOIN securities USING (concept_id) WHERE theme_id IS NOT NULL AND confidence >= 0.5""")
def research_links(spark, d):
    pick = F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_size") % 2 == 0, "openalex").otherwise("arxiv").alias("source"), F.array("p_type").alias("topics"), F.array(pick).alias("institutions"))
    return L.research_links(rows, {"Steel!": "metal", "ECONOMY": "cheap"}, _aliases(spark, d), _securities(spark, d))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN '7' ELSE 'T' || CAST(s_suppkey AS VARCHAR) END AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey % 4 = 1 THEN '7' ELSE s_name END AS name, s_suppkey % 5 = 0 AS former, s_acctbal > 0 AS is_active FROM supplier)
SELECT s_suppkey, CASE WHEN ticker = '7' AND is_active THEN 0 WHEN ticker = '7' THEN 1 WHEN cik = '0000000007' AND is_active THEN 2 WHEN former AND is_active THEN 4 WHEN is_active THEN 5 ELSE 6 END AS priority FROM s WHERE ticker = '7' OR cik = '0000000007' OR name = '7' OR former ORDER BY priority, ticker LIMIT 10""")
def identifier_resolution(spark, d):
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k == 3, "7").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("ticker"), F.lit("X").alias("exchange"), F.lpad(k.cast("string"), 10, "0").alias("cik"), F.when(k % 4 == 1, "7").otherwise(F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("issuer_name"), none.alias("aliases"), F.when(k % 5 == 0, F.array(F.lit("7"))).alias("former_names"), (F.col("s_acctbal") > 0).alias("is_active"))
    return L.resolved_identifier(s, " 7 ", active_only=False).select("s_suppkey", "priority")


_PREDICATE = "CASE l_linenumber % 5 WHEN 0 THEN 'expands_capacity' WHEN 1 THEN 'constrains_capacity' WHEN 2 THEN 'launches_product' WHEN 3 THEN 'delays_product' ELSE 'supplies_to' END"
_POSITIVE = "CASE WHEN l_orderkey % 3 = 0 THEN 'expands_capacity' WHEN l_orderkey % 3 = 1 THEN 'delays_product' ELSE 'supplies_to' END"


@query(f"""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, {_PREDICATE} AS p, {_POSITIVE} AS q FROM lineitem)
SELECT claim_id, CASE WHEN p = q THEN 'support' ELSE 'contradiction' END AS link FROM c WHERE p = q OR (p = 'constrains_capacity' AND q = 'expands_capacity') OR (p = 'launches_product' AND q = 'delays_product')""")
def polarity_links(spark, d):
    return L.polarity_links(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.expr(_PREDICATE).alias("predicate"), F.expr(_POSITIVE).alias("positive")))


@query("""WITH e AS (SELECT l_partkey AS source, 1000000 + l_suppkey AS target, l_returnflag AS predicate, l_linenumber <= 3 AS c FROM lineitem), n AS (SELECT predicate, c, unnest([source, target]) AS x FROM e)
SELECT predicate, count(*) FILTER (c) // 2 AS "current", count(*) FILTER (NOT c) // 2 AS history, count(DISTINCT CASE WHEN c THEN x END) AS concepts FROM n GROUP BY ROLLUP (predicate)""")
def structural_summary(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"), F.col("l_returnflag").alias("predicate"), (F.col("l_linenumber") <= 3).alias("is_current"))
    return L.structural_summary(e)


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 40 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 20 = 1 THEN c_acctbal + 100 WHEN c_custkey % 6 = 0 THEN c_acctbal + 0.5 ELSE c_acctbal END AS v FROM customer), j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.k = b.k), r AS (SELECT count(*) AS n, count(*) FILTER (x IS NULL OR y IS NULL OR abs(x - y) > 1) AS material FROM j)
SELECT n, material, round(material / n, 6) AS rate, CASE WHEN material / n >= 0.15 THEN 'block' WHEN material / n >= 0.05 THEN 'investigate' ELSE 'proceed' END AS advice FROM r""")
def rollout_advice(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    shadow = c.withColumn("v", F.when(F.col("k") % 20 == 1, F.col("v") + 100).when(F.col("k") % 6 == 0, F.col("v") + 0.5).otherwise(F.col("v")))
    current = c.filter("k % 40 <> 0")
    total = current.select("k").union(shadow.select("k")).distinct().agg(F.count("*").alias("n"))
    return L.rollout_advice(K.keyed_diff(current, shadow, ["k"], "v", 1.0), total).withColumn("rate", F.round("rate", 6))
