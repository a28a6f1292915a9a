"""Queries on roll-ups, monitoring, stored rows and ownership filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C, monitoring as M, rollups as R
from ..sources import ownership as O
from .bind import SIGNALS, signals, table
from .registry import query

AT = "2024-01-30 00:00:00"
_SIGN = "CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END"
MENTIONS = f"""{SIGNALS}, mentions AS (SELECT theme_id, theme_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS run_id, entity AS symbol, count(*) AS n, max(confidence) AS composite, avg({_SIGN}) AS sentiment FROM signals GROUP BY 1, 2, 3),
runs AS (SELECT theme_id, theme_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS run_id, count(*) AS n, max(confidence) AS composite, avg({_SIGN}) AS sentiment FROM signals GROUP BY 1, 2)"""


def _runs(spark, d, *more):
    s = signals(spark, d).withColumn("run_id", F.col("theme_id") * 100 + F.dayofmonth("ts")).withColumn("symbol", F.col("entity"))
    v = F.when(F.col("label") == "positive", 1.0).when(F.col("label") == "negative", -1.0).otherwise(0.0)
    return s.groupBy("theme_id", "run_id", *more).agg(F.count("*").alias("n"), F.max("confidence").alias("composite"), F.avg(v).alias("sentiment"))


@query(f"WITH {MENTIONS} SELECT symbol, count(*) AS runs, CAST(sum(n) AS BIGINT) AS documents, round(max(composite), 5) AS max_composite, round(sum(sentiment * n) / sum(n), 5) AS avg_sentiment FROM mentions GROUP BY 1")
def symbol_rollups(spark, d):
    return R.symbol_rollups(_runs(spark, d, "symbol")).select("symbol", "runs", "documents", F.round("max_composite", 5).alias("max_composite"), F.round("avg_sentiment", 5).alias("avg_sentiment"))


@query(f"""WITH {MENTIONS}, t AS (SELECT theme_id, symbol, row_number() OVER (PARTITION BY theme_id ORDER BY sum(n) DESC, symbol) AS place FROM mentions GROUP BY 1, 2), s AS (SELECT theme_id, string_agg(symbol, ',' ORDER BY place) AS top_symbols FROM t WHERE place <= 5 GROUP BY 1)
SELECT theme_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS documents, round(max(composite), 5) AS max_composite, round(sum(sentiment * n) / sum(n), 5) AS avg_sentiment, any_value(top_symbols) AS top_symbols FROM runs JOIN s USING (theme_id) GROUP BY 1""")
def theme_rollups(spark, d):
    out = R.theme_rollups(_runs(spark, d), _runs(spark, d, "symbol"))
    return out.select("theme_id", "runs", "documents", F.round("max_composite", 5).alias("max_composite"), F.round("avg_sentiment", 5).alias("avg_sentiment"), F.array_join("top_symbols", ",").alias("top_symbols"))


@query("""WITH a AS (SELECT o_custkey AS issuer, o_orderkey % 7 AS theme, o_totalprice AS score FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS issuer, o_orderkey % 5 AS theme, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % 3 = 0),
u AS (SELECT issuer, theme, score, NULL AS severity, 0 AS alert FROM a UNION ALL SELECT issuer, theme, NULL, severity, 1 FROM b)
SELECT issuer, count(DISTINCT theme) AS themes, coalesce(round(max(score), 6), 0) AS max_adoption, coalesce(round(min(score), 6), 0) AS min_adoption, coalesce(round(avg(score), 6), 0) AS avg_adoption, count(*) FILTER (alert = 1) AS alerts, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning FROM u GROUP BY 1""")
def issuer_summaries(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "issuer")
    a = o.filter("o_orderkey % 2 = 0").select("issuer", (F.col("o_orderkey") % 7).alias("theme"), F.col("o_totalprice").alias("score"))
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "warning").otherwise("info")
    b = o.filter("o_orderkey % 3 = 0").select("issuer", (F.col("o_orderkey") % 5).alias("theme"), level.alias("severity"))
    out = R.issuer_summaries(a, b)
    return out.select("issuer", "themes", *[F.round(c, 6).alias(c) for c in ("max_adoption", "min_adoption", "avg_adoption")], "alerts", "critical", "warning")


@query("""WITH e AS (SELECT event_id, unnest(['t' || CAST(user_id % 40 AS VARCHAR), 't' || CAST(event_id % 60 AS VARCHAR)]) AS ticker FROM events), t AS (SELECT s_suppkey AS theme_id, unnest(['t' || CAST(s_suppkey % 50 AS VARCHAR), 't' || CAST(s_nationkey AS VARCHAR)]) AS ticker FROM supplier)
SELECT DISTINCT event_id, theme_id FROM e JOIN t USING (ticker)""")
def event_theme_links(spark, d):
    t = lambda c: F.concat(F.lit("t"), c.cast("string"))
    e = table(spark, d, "events").select("event_id", F.array(t(F.col("user_id") % 40), t(F.col("event_id") % 60)).alias("tickers"))
    themes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("theme_id"), F.array(t(F.col("s_suppkey") % 50), t(F.col("s_nationkey"))).alias("tickers"))
    return R.linked_events(e, themes)


@query("""WITH e AS (SELECT event_id AS doc_id, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN upper(event_type) || ' ' ELSE event_type END AS action, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'u' || CAST(user_id % 9 AS VARCHAR) END AS actor, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.5 + (event_id % 10) / 100.0 END AS confidence FROM events),
n AS (SELECT *, lower(trim(action)) AS k1, lower(trim(coalesce(actor, ''))) AS k2 FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY created_at, doc_id) AS r, count(*) OVER (PARTITION BY k1, k2) AS sources FROM n)
SELECT doc_id, CAST(created_at AS VARCHAR) AS created_at, action, actor, round(least(1.0, coalesce(confidence, 0.7) + 0.05 * (sources - 1)), 4) AS confidence, sources FROM f WHERE r = 1""")
def event_dedupe(spark, d):
    action = F.when(F.col("event_id") % 2 == 0, F.concat(F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type"))
    actor = F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")))
    conf = F.when(F.col("event_id") % 5 != 0, 0.5 + (F.col("event_id") % 10) / 100.0)
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"), action.alias("action"), actor.alias("actor"), conf.alias("confidence"))
    return R.distinct_events(e, ["action", "actor"]).select("doc_id", F.col("created_at").cast("string").alias("created_at"), "action", "actor", F.round("confidence", 4).alias("confidence"), "sources")


_KIND = "CASE event_type WHEN 'click' THEN 'capacity_expansion' WHEN 'view' THEN 'capacity_constraint' WHEN 'purchase' THEN 'product_launch' WHEN 'error' THEN 'product_delay' ELSE 'other' END"


@query(f"""WITH e AS (SELECT user_id, {_KIND} AS k FROM events), n AS (SELECT user_id, count(*) FILTER (k = 'capacity_expansion') - count(*) FILTER (k = 'capacity_constraint') AS supply, count(*) FILTER (k = 'product_launch') - count(*) FILTER (k = 'product_delay') AS product FROM e GROUP BY 1)
SELECT user_id, supply, product, CASE WHEN abs(supply) >= abs(product) THEN CASE WHEN supply > 0 THEN 'supply_increasing' WHEN supply < 0 THEN 'supply_decreasing' END WHEN product > 0 THEN 'product_momentum' ELSE 'product_risk' END AS signal FROM n""")
def investment_signal(spark, d):
    return R.investment_signals(table(spark, d, "events").select("user_id", F.expr(_KIND).alias("event_type")), "user_id")


@query("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS patent_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'f' || CAST(o_custkey AS VARCHAR) END AS family_id, CASE WHEN o_orderkey % 8 = 0 THEN 'a' || CAST(o_custkey AS VARCHAR) END AS application_id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS grant_date, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(family_id, ''), nullif(application_id, ''), patent_id) ORDER BY grant_date IS NOT NULL DESC, coalesce(event_date, DATE '0001-01-01') DESC, patent_id DESC) AS n FROM p)
SELECT patent_id, family_id, application_id, CAST(event_date AS VARCHAR) AS event_date FROM r WHERE n = 1""")
def patent_families(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    cust = F.col("o_custkey").cast("string")
    rows = o.select(F.col("o_orderkey").cast("string").alias("patent_id"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("f"), cust)).alias("family_id"), F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit("a"), cust)).alias("application_id"), F.when(F.col("o_orderstatus") == "F", day).alias("grant_date"), F.when(F.col("o_orderkey") % 5 != 0, day).alias("event_date"))
    return R.patent_families(rows).select("patent_id", "family_id", "application_id", F.col("event_date").cast("string").alias("event_date"))


@query(r"""WITH p AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS record_id, CASE WHEN l_linenumber % 2 = 0 THEN 'openalex' ELSE 'arxiv' END AS source, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'https://doi.org/10.1/X' ELSE '10.1/x' END || CAST(l_partkey AS VARCHAR) END AS doi, CASE WHEN l_orderkey % 3 = 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'a' END || CAST(l_suppkey AS VARCHAR) END AS arxiv_id, CAST(l_quantity AS BIGINT) % 4 AS n_institutions FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doi <> '' THEN 'doi:' || regexp_replace(lower(trim(doi)), '^https://doi\.org/', '') WHEN arxiv_id <> '' THEN 'arxiv:' || lower(arxiv_id) ELSE source || ':' || record_id END ORDER BY source = 'openalex' DESC, n_institutions DESC, record_id DESC) AS n FROM p)
SELECT record_id, source, n_institutions FROM r WHERE n = 1""")
def research_records(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    doi = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.when(even, "https://doi.org/10.1/X").otherwise("10.1/x"), F.col("l_partkey").cast("string")))
    arxiv = F.when(F.col("l_orderkey") % 3 == 1, F.concat(F.when(even, "A").otherwise("a"), F.col("l_suppkey").cast("string")))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("record_id"), F.when(even, "openalex").otherwise("arxiv").alias("source"), doi.alias("doi"), arxiv.alias("arxiv_id"), (F.col("l_quantity").cast("long") % 4).alias("n_institutions"))
    return R.research_records(rows).select("record_id", "source", "n_institutions")


_CHECKS = """WITH o AS (SELECT o_orderpriority AS lane, o_orderkey % 10 <> 0 AS a, o_orderkey % 20 = 0 AS b, o_orderstatus <> 'P' AS c, o_orderdate < TIMESTAMP '1994-01-01' AS s FROM orders), r AS (SELECT lane, avg(a::INT) AS a, avg(b::INT) AS b, avg(c::INT) AS c, avg(s::INT) AS s FROM o GROUP BY 1),
k AS (SELECT lane, 'lineage_completeness' AS "check", a AS value, CASE WHEN a >= 0.95 THEN 'ok' WHEN a >= 0.85 THEN 'warning' ELSE 'critical' END AS severity FROM r UNION ALL SELECT lane, 'unresolved_entities', b, CASE WHEN b <= 0.05 THEN 'ok' WHEN b <= 0.15 THEN 'warning' ELSE 'critical' END FROM r
UNION ALL SELECT lane, 'filing_parse_quality', c, CASE WHEN c >= 0.90 THEN 'ok' WHEN c >= 0.75 THEN 'warning' ELSE 'critical' END FROM r UNION ALL SELECT lane, 'stale_evidence', s, CASE WHEN s <= 0.10 THEN 'ok' WHEN s <= 0.25 THEN 'warning' ELSE 'critical' END FROM r)"""


def _checks(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "lane")
    return M.ratio_checks(o, "lane", {"lineage_completeness": F.col("o_orderkey") % 10 != 0, "unresolved_entities": F.col("o_orderkey") % 20 == 0, "filing_parse_quality": F.col("o_orderstatus") != "P", "stale_evidence": F.col("o_orderdate") < F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")})


@query(f'{_CHECKS} SELECT lane, "check", round(value, 6) AS value, severity FROM k')
def quality_checks(spark, d):
    return _checks(spark, d).withColumn("value", F.round("value", 6))


@query(f"{_CHECKS} SELECT lane, CASE max(CASE severity WHEN 'ok' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) WHEN 1 THEN 'ok' WHEN 2 THEN 'warning' ELSE 'critical' END AS severity FROM k GROUP BY 1")
def quality_report(spark, d):
    return M.worst(_checks(spark, d), "lane")


@query(f"""WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'narrative' WHEN 'view' THEN 'filing' ELSE 'other' END AS lane, ts FROM events WHERE ts < TIMESTAMP '2024-01-27 00:00:00'), l AS (SELECT unnest(['narrative', 'filing', 'other', 'backtest']) AS lane), m AS (SELECT lane, (epoch_us(TIMESTAMP '{AT}') - epoch_us(max(ts))) / 3600000000.0 AS h, CASE lane WHEN 'narrative' THEN 6.0 WHEN 'filing' THEN 72.0 WHEN 'backtest' THEN 168.0 ELSE 24.0 END AS b FROM l LEFT JOIN r USING (lane) GROUP BY lane)
SELECT lane, CASE WHEN h IS NULL THEN 999.0 ELSE round(h / b, 4) END AS value, CASE WHEN h IS NULL OR h > b THEN 'critical' WHEN h > 0.75 * b THEN 'warning' ELSE 'ok' END AS severity FROM m""")
def freshness_budgets(spark, d):
    lane = F.when(F.col("event_type") == "click", "narrative").when(F.col("event_type") == "view", "filing").otherwise("other")
    runs = table(spark, d, "events").filter("ts < timestamp_ntz'2024-01-27 00:00:00'").select(lane.alias("lane"), F.col("ts").alias("completed_at"))
    lanes = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("narrative", "filing", "other", "backtest")])).alias("lane"))
    return M.freshness_budgets(runs, lanes, F.lit(AT).cast("timestamp_ntz"))


@query("WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, CASE WHEN n >= 50 THEN 'critical' WHEN n >= 30 THEN 'warning' ELSE 'ok' END AS severity FROM n ORDER BY n.day DESC LIMIT 1")
def creation_rate_drift(spark, d):
    return M.latest_daily_count(table(spark, d, "events"), "ts", 30, 50).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {SIGNALS}, m AS (SELECT theme_id, CAST(ts AS DATE) AS day, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0 END) AS v FROM signals GROUP BY 1, 2), z AS (SELECT theme_id, day, CASE WHEN count(v) OVER w < 2 OR stddev_pop(v) OVER w < 1e-10 THEN 0.0 ELSE abs(v - avg(v) OVER w) / stddev_pop(v) OVER w END AS zscore FROM m WINDOW w AS (PARTITION BY theme_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT theme_id, CAST(day AS VARCHAR) AS day, round(zscore, 3) AS zscore, CASE WHEN zscore >= 3 THEN 'critical' WHEN zscore >= 2 THEN 'warning' ELSE 'ok' END AS severity FROM z""")
def calibration_shift(spark, d):
    s = signals(spark, d).withColumn("bullish", F.when(F.col("label") == "positive", 1.0).otherwise(0.0))
    return M.calibration_shift(s, "theme_id", "ts", "bullish", 2, 3).select("theme_id", F.col("day").cast("string").alias("day"), F.round("zscore", 3).alias("zscore"), "severity")


@query("""WITH m AS (SELECT c_mktsegment AS lane, 'balance' AS metric, avg(c_acctbal) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'size', CAST(count(*) AS DOUBLE) FROM customer GROUP BY 1), t AS (SELECT * FROM (VALUES ('low', 'balance', 4500.0, false, 'quarantine'), ('large', 'size', 30.0, true, 'alert'), ('none', 'absent', 0.0, true, 'alert')) v("trigger", metric, threshold, above, action))
SELECT lane, "trigger", action, round(value, 3) AS value, CAST(threshold AS DOUBLE) AS threshold FROM m JOIN t USING (metric) WHERE CASE WHEN above THEN value > threshold ELSE value < threshold END""")
def quarantine_triggers(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("lane")).agg(F.avg("c_acctbal").alias("balance"), F.count("*").cast("double").alias("size"))
    t = spark.createDataFrame([("low", "balance", 4500.0, False, "quarantine"), ("large", "size", 30.0, True, "alert"), ("none", "absent", 0.0, True, "alert")], "trigger string, metric string, threshold double, above boolean, action string")
    return M.fired(g.unpivot(["lane"], ["balance", "size"], "metric", "value"), t).withColumn("value", F.round("value", 3))


@query("""WITH m AS (SELECT c_mktsegment AS variant, 'n' || CAST(c_nationkey AS VARCHAR) AS metric, sum(c_acctbal) AS value FROM customer GROUP BY 1, 2), v AS (SELECT unnest(['AUTOMOBILE', 'FURNITURE', 'MACHINERY']) AS variant), b AS (SELECT metric, value AS b FROM m WHERE variant = 'BUILDING'), k AS (SELECT DISTINCT metric FROM m)
SELECT v.variant, k.metric, round(coalesce(m.value, 0) - coalesce(b, 0), 2) AS delta FROM v, k LEFT JOIN m ON m.variant = v.variant AND m.metric = k.metric LEFT JOIN b ON b.metric = k.metric WHERE m.value IS NOT NULL OR b IS NOT NULL""")
def ablation_deltas(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("variant"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("metric")).agg(F.sum("c_acctbal").alias("value"))
    return M.baseline_deltas(m, "BUILDING", ["AUTOMOBILE", "FURNITURE", "MACHINERY"]).withColumn("delta", F.round("delta", 2))


@query("""WITH a AS (SELECT p_brand, p_type FROM part), b AS (SELECT p_brand, CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE p_type END AS p_type FROM part)
SELECT 'missing' AS side, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS rows UNION ALL SELECT 'unexpected', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def bundle_parity(spark, d):
    p = table(spark, d, "part")
    return M.parity(p.select("p_brand", "p_type"), p.select("p_brand", F.when(F.col("p_partkey") % 10 == 0, "changed").otherwise(F.col("p_type")).alias("p_type")))


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AT}' - INTERVAL 10 DAY AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def retention(spark, d):
    kept = C.retained(table(spark, d, "events"), "ts", F.lit(AT).cast("timestamp_ntz"), 10)
    gone = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("user_id"))
    return C.without(kept, gone, "user_id").select("event_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '2020-01-01 00:00:00' WHEN s_acctbal < 0 OR s_suppkey % 3 = 0 THEN '2024-01-30 00:00:00' END AS deleted_at FROM supplier")
def soft_delete(spark, d):
    s = table(spark, d, "supplier").withColumn("deleted_at", F.when(F.col("s_suppkey") % 4 == 0, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))
    out = C.soft_deleted(s, (F.col("s_acctbal") < 0) | (F.col("s_suppkey") % 3 == 0), F.lit(AT).cast("timestamp_ntz"))
    return out.select("s_suppkey", F.col("deleted_at").cast("string").alias("deleted_at"))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS k, 't' || CAST(o_orderkey % 4 AS VARCHAR) AS t FROM orders), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN ['t1', 't9'] ELSE [] END AS a FROM customer), g AS (SELECT k, list_sort(list(t)) AS b FROM n GROUP BY 1)
SELECT k AS c_custkey, array_to_string(list_concat(a, list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))), ',') AS theme_ids FROM o LEFT JOIN g USING (k)""")
def theme_ids_union(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string")).alias("theme_ids"))
    old = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.array(F.lit("t1"), F.lit("t9"))).alias("theme_ids"))
    return C.with_added(old, new, "c_custkey", "theme_ids").select("c_custkey", F.array_join("theme_ids", ",").alias("theme_ids"))


@query("""SELECT event_id, event_type = 'click' OR user_id % 5 = 0 AS affected, CASE WHEN event_type = 'click' THEN 'kind:merged' ELSE 'event:' || event_type END || ',' || CASE WHEN user_id % 5 = 0 THEN 'kind:merged' ELSE 'event:other' END AS entities FROM events""")
def entity_merge(spark, d):
    part = lambda name: F.struct(F.lit("event").alias("type"), name.alias("normalized"))
    rows = table(spark, d, "events").select("event_id", F.array(part(F.col("event_type")), part(F.when(F.col("user_id") % 5 == 0, "click").otherwise("other"))).alias("entities"))
    out = C.merged_entity(rows, ("event", "click"), ("kind", "merged"))
    return out.select("event_id", "affected", F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["normalized"])), ",").alias("entities"))


@query("""WITH c AS (SELECT s_suppkey, 'C' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cusip, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 1100 END AS shares FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT s_suppkey AS filer, cusip, CAST(shares AS DOUBLE) AS shares, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1000 * s_suppkey END AS DOUBLE) AS previous_shares, CAST(CASE WHEN s_suppkey % 2 = 0 THEN shares - 1000 * s_suppkey END AS DOUBLE) AS delta_shares FROM c""")
def holdings_delta(spark, d):
    s = table(spark, d, "supplier")
    cusip = F.concat(F.lit("c"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))
    n = F.when(F.col("s_suppkey") % 6 != 0, F.format_number(F.col("s_suppkey") * 1100, 0)).otherwise("")
    row = F.concat(F.lit("<n1:infoTable><n1:nameOfIssuer>x</n1:nameOfIssuer><n1:cusip>"), cusip, F.lit("</n1:cusip><n1:value>5</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>"), n, F.lit("</n1:sshPrnamt></n1:shrsOrPrnAmt></n1:infoTable>"))
    xml = F.concat(F.lit("<n1:informationTable>"), F.when(F.col("s_suppkey") % 11 != 0, row).otherwise(""), F.lit("</n1:informationTable>"))
    good, _ = O.holdings(s.select(F.col("s_suppkey").alias("filer"), F.lit("2024-01-01").alias("filed"), xml.alias("content")))
    old = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("filer"), F.upper(cusip).alias("cusip"), (F.col("s_suppkey") * 1000).cast("decimal(38,4)").alias("shares"))
    out = C.position_changes(good.select("filer", "cusip", "shares"), old, ["filer", "cusip"])
    return out.select("filer", "cusip", *[F.col(c).cast("double").alias(c) for c in ("shares", "previous_shares", "delta_shares")])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'schedule_13g_ownership' ELSE 'schedule_13d_ownership' END AS event_type, 'AB' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS cusip, CAST(CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 90) + 0.5 END AS DOUBLE) AS percent, CAST(c_custkey * 1000 AS DOUBLE) AS position_shares FROM customer""")
def ownership_schedules(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("CUSIP No. ab"), F.lpad(k.cast("string"), 7, "0"), F.lit("\nAggregate Amount Beneficially Owned by each: "), F.format_number(k * 1000, 0), F.lit("\n"), F.when(k % 3 != 0, F.concat(F.lit("percent of class in row:\n"), (k % 90).cast("string"), F.lit(".5 %"))).otherwise(""))
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, "SC 13G/A").otherwise("SC 13D").alias("form"), text.alias("content"))
    return O.schedules(rows).select("c_custkey", "event_type", "cusip", *[F.col(c).cast("double").alias(c) for c in ("percent", "position_shares")])
