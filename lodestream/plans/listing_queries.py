"""Queries that list published objects and stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C, listings as L, publish as P
from .bind import table
from .registry import query

_ASSERTIONS = """pub AS (SELECT o_orderkey AS object_id, 'lane' || CAST(o_custkey % 3 AS VARCHAR) AS lane, 'm' || CAST(extract(year FROM o_orderdate) AS VARCHAR) AS manifest_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'claim' WHEN o_orderkey % 3 = 1 THEN 'assertion' ELSE 'divergence' END AS object_type, CASE WHEN o_orderkey % 10 = 0 THEN 'draft' ELSE 'published' END AS publish_state,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'l' || CAST(o_custkey % 40 AS VARCHAR) END AS key, o_custkey % 10 AS subject, o_custkey % 7 AS object, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_custkey % 10) / 10.0 END AS confidence, o_orderkey, o_custkey FROM orders),
ptr AS (SELECT lane, max(manifest_id) AS manifest_id FROM pub WHERE created_at <= TIMESTAMP '1998-06-01' GROUP BY 1),
latest AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.lane, object_type, key ORDER BY created_at DESC, object_id DESC) AS n FROM pub p JOIN ptr USING (lane, manifest_id) WHERE publish_state = 'published') WHERE n = 1)"""


def _published(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "claim").when(k % 3 == 1, "assertion").otherwise("divergence")
    logical = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("l"), (c % 40).cast("string")))
    confidence = F.when(k % 5 == 0, "high").otherwise(((c % 10) / 10.0).cast("string"))
    payload = F.to_json(F.struct(
        logical.alias("assertion_id"), logical.alias("claim_id"), logical.alias("divergence_id"), (c % 10).cast("string").alias("subject_concept_id"), (c % 7).cast("string").alias("object_concept_id"), F.col("o_orderstatus").alias("status"), confidence.alias("confidence"),
        F.when(c % 2 == 0, "critical").alias("severity"), F.concat(F.lit("i"), (c % 6).cast("string")).alias("issuer_concept_id"), F.array(F.concat(F.lit("l"), ((c + 1) % 40).cast("string"))).alias("claim_ids"),
        F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("l"), (c % 5).cast("string")).alias("assertion_id")))).alias("links"), F.concat(F.lit("l"), (c % 8).cast("string")).alias("linked_assertion_id"),
    ))
    rows = o.select(k.alias("object_id"), F.concat(F.lit("lane"), (c % 3).cast("string")).alias("lane"), F.concat(F.lit("m"), F.year("o_orderdate").cast("string")).alias("manifest_id"), F.col("o_orderdate").alias("created_at"), kind.alias("object_type"), F.when(k % 10 == 0, "draft").otherwise("published").alias("publish_state"), payload.alias("payload"))
    return rows, P.active_pointers(rows.select("lane", "manifest_id", F.col("created_at").alias("activated_at")), F.lit("1998-06-01").cast("timestamp_ntz"))


@query(f"WITH {_ASSERTIONS} SELECT object_id, lane FROM latest WHERE object_type = 'assertion' AND (subject = 3 OR object = 3) AND confidence >= 0.3")
def assertion_listing(spark, d):
    return L.assertions(*_published(spark, d), concept="3", least=0.3).select("object_id", "lane")


# the payload's own assertion_id of a claim is its logical key
@query(f"WITH {_ASSERTIONS}, emb AS (SELECT 'l' || CAST((o_custkey + 1) % 40 AS VARCHAR) AS claim FROM latest WHERE object_type = 'assertion' AND key = 'l3') SELECT DISTINCT object_id, lane FROM latest WHERE object_type = 'claim' AND (key = 'l3' OR o_custkey % 8 = 3 OR (o_orderkey % 2 = 0 AND o_custkey % 5 = 3) OR key IN (SELECT claim FROM emb))")
def claim_listing(spark, d):
    return L.claims(*_published(spark, d), assertion="l3").select("object_id", "lane").distinct()


@query(f"WITH {_ASSERTIONS}, a AS (SELECT key, 'l' || CAST((o_custkey + 1) % 40 AS VARCHAR) AS claim FROM latest WHERE object_type = 'assertion'), c AS (SELECT key, CASE WHEN starts_with(key, 'l') THEN key ELSE '' END AS of FROM latest WHERE object_type = 'claim') SELECT a.key AS assertion_id, a.claim AS claim_id FROM a WHERE a.claim IN (SELECT key FROM c) UNION SELECT c.of, c.key FROM c WHERE c.of IN (SELECT key FROM a)")
def assertion_claims(spark, d):
    return L.linked_claims(*_published(spark, d))


@query(f"WITH {_ASSERTIONS} SELECT CASE WHEN o_custkey % 2 = 0 THEN 'critical' ELSE 'info' END AS severity, 'i' || CAST(o_custkey % 6 AS VARCHAR) AS issuer, count(*) AS n FROM latest WHERE object_type = 'divergence' GROUP BY 1, 2")
def divergence_listing(spark, d):
    return L.divergences(*_published(spark, d)).groupBy("severity", "issuer").agg(F.count("*").alias("n"))


@query(f"WITH {_ASSERTIONS} SELECT object_id, CASE WHEN o_custkey % 2 = 0 THEN 'critical' ELSE 'info' END AS severity FROM latest WHERE object_type = 'divergence' AND o_custkey % 6 = 2")
def issuer_divergence(spark, d):
    return L.divergences(*_published(spark, d), issuer="i2").select("object_id", "severity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND (l_suppkey = 3 OR l_partkey = 3) AND l_linestatus = 'O'")
def concept_relationships(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"), F.col("l_linestatus").alias("kind"), (F.col("l_returnflag") != "R").alias("is_active"))
    return L.relationships(li, "3", kind="O").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT c_custkey AS concept, o_orderkey FROM orders, customer WHERE (c_custkey = o_custkey OR c_custkey = o_orderkey % 50) AND c_custkey % 3 = 0")
def concept_assertions(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 50).alias("object"))
    return L.of_concept(a, table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("concept"))).select("concept", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_brand LIKE 'Brand#1%' AND p_size % 3 = 1")
def factor_series_listing(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("is_active"), F.array(F.substring("p_brand", 1, 7), F.lit("x")).alias("tags"), (F.col("p_size") % 3).cast("string").alias("provider"))
    return L.series(p, tag="Brand#1", provider="1").select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 20")
def recent_alerts(spark, d):
    return L.recent(table(spark, d, "events"), [F.col("event_type") == "error", F.col("user_id") % 2 == 0], "ts", 20, "event_id").select("event_id")


@query("SELECT o_orderkey AS run_id, c_name AS theme FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey % 5 DESC, o_orderkey LIMIT 15")
def momentum_listing(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("theme_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"), F.col("o_totalprice").alias("conviction"), (F.col("o_orderkey") % 5).alias("rate"), F.lit(0.0).alias("acceleration"))
    return L.momentum(runs, table(spark, d, "customer").select(F.col("c_custkey").alias("theme_id"), F.col("c_name").alias("theme")), 15).select("run_id", "theme")


@query("SELECT o_orderkey AS run_id, l_linenumber AS doc FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def run_documents(spark, d):
    members = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"))
    docs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("doc"))
    return docs.join(members, "run_id", "left_semi").select("run_id", "doc")


@query("SELECT event_id AS doc_id, unnest(CASE WHEN user_id % 20 IN (1, 2) AND event_id % 30 IN (1, 2) THEN ['a', 'b'] WHEN user_id % 20 IN (1, 2) THEN ['a'] ELSE ['b'] END) AS kind FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND (user_id % 20 IN (1, 2) OR event_id % 30 IN (1, 2))")
def events_by_tickers(spark, d):
    t = lambda c: F.array(F.concat(F.lit("t"), c.cast("string")))
    events = F.array(F.struct(F.lit("a").alias("event_type"), t(F.col("user_id") % 20).alias("tickers")), F.struct(F.lit("b").alias("event_type"), t(F.col("event_id") % 30).alias("tickers")))
    docs = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts", events.alias("events"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return L.events_of(docs, ["t1", "t2"], at("2024-01-05"), at("2024-01-25")).select("doc_id", F.col("e.event_type").alias("kind"))


@query("""SELECT o_orderkey AS answer_id, 'first' AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) || ',d' ELSE 'd' END AS claim_ids FROM orders WHERE o_orderkey % 5 > 0""")
def cited_answers(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    own = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    entry = lambda text, *ids: F.struct(F.lit(text).alias("text"), F.array(*ids).alias("claim_ids"))
    payload = F.when(k % 5 == 0, "no json").otherwise(F.to_json(F.struct(F.array(entry(" first ", own, F.lit("zz"), F.lit("d"), own), entry("invented", F.lit("zz"), F.lit("zz"), F.lit("zz"), F.lit("zz")), entry(" ", F.lit("d"), F.lit("d"), F.lit("d"), F.lit("d"))).alias("entries"))))
    valid = o.filter("o_orderkey % 2 = 0").select(k.alias("answer_id"), own.alias("claim_id")).union(o.select(k, F.lit("d")))
    return L.cited(o.select(k.alias("answer_id"), payload.alias("payload")), valid).select("answer_id", "text", F.concat_ws(",", "claim_ids").alias("claim_ids"))


@query("SELECT l_orderkey, string_agg('- [' || CAST(l_linenumber AS VARCHAR) || '] part ' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, 'part ' || CAST(l_partkey AS VARCHAR)) AS block FROM lineitem GROUP BY 1")
def claims_blocks(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("claim_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    return L.claims_block(c, "l_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'contradicts' WHEN event_id % 4 = 1 THEN 'agrees' END AS relation, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 END::DOUBLE AS confidence FROM events")
def parsed_verdicts(spark, d):
    p = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"relation": "contradicts", "confidence": 7}' WHEN 1 THEN '{"relation": "agrees", "confidence": 0.25}' WHEN 2 THEN '{"relation": "agrees", "confidence": "0.5"}' ELSE '{"relation": "maybe", "confidence": 1}' END""")
    v = table(spark, d, "events").select("event_id", L.verdict(p, ["contradicts", "agrees", "unrelated"]).alias("v"))
    return v.select("event_id", "v.relation", "v.confidence")


@query("SELECT concept, count(*) AS signals, min(o_orderkey) AS first FROM (SELECT o_orderkey, unnest(CASE WHEN o_custkey % 9 = o_orderkey % 9 THEN ['c' || CAST(o_custkey % 9 AS VARCHAR)] ELSE ['c' || CAST(o_custkey % 9 AS VARCHAR), 'c' || CAST(o_orderkey % 9 AS VARCHAR)] END) AS concept FROM orders) GROUP BY 1")
def concept_evidence(spark, d):
    c = lambda x: F.concat(F.lit("c"), (F.col(x) % 9).cast("string"))
    s = table(spark, d, "orders").select(c("o_custkey").alias("issuer_concept_id"), c("o_orderkey").alias("security_concept_id"), F.lit("t").alias("theme_id"), F.lit("2024-01-01").alias("event_date"), F.col("o_orderkey").alias("signal_id"), F.lit("x").alias("title"), F.lit(0.5).alias("confidence"))
    return L.grouped_evidence(s, "concept").select("concept", F.size("evidence").cast("long").alias("signals"), F.col("evidence")[0]["signal_id"].alias("first"))


@query("SELECT 't' || CAST(o_custkey % 9 AS VARCHAR) AS theme_id, count(*) AS signals FROM orders GROUP BY 1")
def theme_evidence(spark, d):
    s = table(spark, d, "orders").select(F.lit("a").alias("issuer_concept_id"), F.lit("b").alias("security_concept_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 9).cast("string")).alias("theme_id"), F.lit("2024-01-01").alias("event_date"), F.col("o_orderkey").alias("signal_id"), F.lit("x").alias("title"), F.lit(0.5).alias("confidence"))
    return L.grouped_evidence(s, "theme_id").select("theme_id", F.size("evidence").cast("long").alias("signals"))
