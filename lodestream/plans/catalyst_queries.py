"""Queries on catalysts, backtest days, alerts, authors, claims from text, parity checks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S, text as X
from ..operators import backtest as B, catalysts as K, claims as C, parity as P, rollups as R, themes as T
from ..sources.scratch import parts
from .bind import SIGNALS, signals, table
from .claim_queries import AT, CLAIMS, KEY, claims
from .market_queries import BARS, bars
from .registry import query
from .rollup_queries import _KIND

_SENT = "(n_nationkey - 12) / 25.0::DOUBLE"
_SIGNAL = "CASE n_nationkey % 6 WHEN 0 THEN 'supply_increasing' WHEN 1 THEN 'product_risk' WHEN 2 THEN 'other_signal' WHEN 3 THEN 'supply_decreasing' END"
_BIAS = """CASE WHEN t IS NOT NULL AND s IS NOT NULL AND t <> s THEN 'mixed' ELSE coalesce(t, s, 'mixed') END"""
_SIDES = "CASE {sig} WHEN 'supply_increasing' THEN 'bullish' WHEN 'product_momentum' THEN 'bullish' WHEN 'supply_decreasing' THEN 'bearish' WHEN 'product_risk' THEN 'bearish' END AS t, CASE WHEN {sent} >= 0.08 THEN 'bullish' WHEN {sent} <= -0.08 THEN 'bearish' END AS s"
_DELTA = "CASE bias WHEN 'bullish' THEN least(0.35, greatest(0.15, abs(sent))) WHEN 'bearish' THEN -least(0.35, greatest(0.15, abs(sent))) ELSE sign(sent) * least(0.35, greatest(0.15, abs(sent))) END"


@query(f"WITH a AS (SELECT n_nationkey, {_SENT} AS sent, {_SIDES.format(sig=_SIGNAL, sent=_SENT)} FROM nation), b AS (SELECT n_nationkey, sent, {_BIAS} AS bias FROM a) SELECT n_nationkey, bias, round({_DELTA}, 6)::DOUBLE AS delta FROM b")
def market_bias(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") - 12) / 25.0).alias("sent"), F.expr(_SIGNAL).alias("signal")).withColumn("bias", S.market_bias(F.col("sent"), F.col("signal")))
    return n.select("n_nationkey", "bias", F.round(S.propagation_delta(F.col("sent"), F.col("bias")), 6).alias("delta"))


_DOMINANT = f"""c AS (SELECT user_id % 10 AS theme_id, {_KIND} AS k, count(*) AS n FROM events GROUP BY 1, 2), dom AS (SELECT theme_id, sum(n)::BIGINT AS events, list(k ORDER BY n DESC, k)[1:3] AS dominant FROM c GROUP BY 1)"""


@query(f"WITH {_DOMINANT} SELECT theme_id, events, array_to_string(dominant, ',') AS dominant FROM dom")
def dominant_event_types(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("theme_id"), F.expr(_KIND).alias("event_type"))
    return K.dominant_events(e, "theme_id").select("theme_id", "events", F.concat_ws(",", "dominant").alias("dominant"))


_IMPACTS = [("AUTOMOBILE", "BUILDING", 0.9), ("AUTOMOBILE", "X1", 0.8), ("BUILDING", "X1", 0.4), ("FURNITURE", "X2", -0.7), ("MACHINERY", "X3", 0.5), ("HOUSEHOLD", "X1", 0.3), ("HOUSEHOLD", "X4", 0.2)]


@query(f"""WITH {_DOMINANT}, {SIGNALS}, m AS (SELECT theme_id, count(*) AS n, avg(authority) AS auth, CAST(ts AS DATE) AS date FROM signals GROUP BY theme_id, CAST(ts AS DATE)), lm AS (SELECT theme_id, arg_max(n, date) / 7.0 - 2 AS z, arg_max(coalesce(auth, -1), date) AS auth FROM m GROUP BY 1),
inv AS (SELECT user_id % 10 AS theme_id, count(*) FILTER ({_KIND} = 'capacity_expansion') - count(*) FILTER ({_KIND} = 'capacity_constraint') AS supply, count(*) FILTER ({_KIND} = 'product_launch') - count(*) FILTER ({_KIND} = 'product_delay') AS product FROM events GROUP BY 1),
sg AS (SELECT theme_id, CASE WHEN abs(supply) >= abs(product) THEN CASE WHEN supply > 0 THEN 'supply_increasing' WHEN supply < 0 THEN 'supply_decreasing' END WHEN product > 0 THEN 'product_momentum' ELSE 'product_risk' END AS sig FROM inv),
tc AS (SELECT c_nationkey AS run_id, c_mktsegment AS ticker, count(*) AS n FROM customer GROUP BY 1, 2), pt AS (SELECT run_id, list(ticker ORDER BY n DESC, ticker)[1:3] AS prim FROM tc GROUP BY 1),
r AS (SELECT n_nationkey AS run_id, n_nationkey % 10 AS theme_id, {_SENT} AS sent, n_nationkey * 4.0 AS conv, n_nationkey % 7 - 3.0 AS acc, n_nationkey % 5 AS plat, prim, sig, z, CASE WHEN auth >= 0 THEN auth END AS auth, dominant, events FROM nation JOIN pt ON run_id = n_nationkey LEFT JOIN dom ON dom.theme_id = n_nationkey % 10 LEFT JOIN sg ON sg.theme_id = n_nationkey % 10 LEFT JOIN lm ON lm.theme_id = n_nationkey % 10),
a AS (SELECT *, {_SIDES.format(sig='sig', sent='sent')} FROM r), b AS (SELECT *, {_BIAS} AS bias FROM a), g AS (SELECT *, {_DELTA} AS delta FROM b),
im AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _IMPACTS)}) v(source, target, impact)),
x AS (SELECT run_id, target, max(abs(round(impact * delta, 4))) AS size FROM (SELECT run_id, delta, prim, unnest(prim) AS source FROM g WHERE delta <> 0) JOIN im USING (source) WHERE NOT list_contains(prim, target) GROUP BY 1, 2), rel AS (SELECT run_id, list(target ORDER BY size DESC, target)[1:5] AS rel FROM x GROUP BY 1)
SELECT run_id, bias, round(delta, 6)::DOUBLE AS delta, array_to_string(prim, ',') AS primary_tickers, coalesce(array_to_string(rel, ','), '') AS related_tickers, round(least(100.0, least(conv * 0.55, 55.0) + least(greatest(coalesce(z, 0), 0) * 12.0, 18.0) + least(greatest(acc, 0) * 4.0, 12.0) + least(plat * 3.0, 9.0) + least(greatest(coalesce(auth, 0), 0) * 15.0, 12.0) + least(coalesce(events, 0) * 2.0, 8.0)), 1)::DOUBLE AS impact,
 CASE bias WHEN 'bullish' THEN 'Bullish setup' WHEN 'bearish' THEN 'Bearish setup' ELSE 'Mixed setup' END || ' for ' || array_to_string(list_transform(prim, lambda t: '$' || t), ', ') || '. Ai Chip ' || CAST(theme_id AS VARCHAR) || ' is spreading across ' || CAST(plat AS VARCHAR) || ' platforms'
 || CASE sig WHEN 'supply_increasing' THEN ' with expanding supply' WHEN 'supply_decreasing' THEN ' with tightening supply' WHEN 'product_momentum' THEN ' with product momentum' WHEN 'product_risk' THEN ' with product risk' ELSE ' around ' || array_to_string(list_transform(dominant[1:2], lambda e: replace(e, '_', ' ')), ', ') END
 || CASE WHEN z > 0 THEN ', backed by volume z-score ' || printf('%.1f', z) ELSE '' END || ' and conviction ' || CAST(conv::BIGINT AS VARCHAR) || '.' || CASE WHEN rel IS NOT NULL THEN ' Watch follow-through in ' || array_to_string(list_transform(rel[1:2], lambda t: '$' || t), ', ') || '.' ELSE '' END AS summary FROM g LEFT JOIN rel USING (run_id)""")
def market_catalysts(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy(F.col("c_nationkey").alias("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("ticker_counts"))
    runs = n.select(k.alias("run_id"), (k % 10).alias("theme_id"), F.concat(F.lit("ai_chip_"), (k % 10).cast("string")).alias("theme_name"), ((k - 12) / 25.0).alias("avg_sentiment"), F.lit(0.5).alias("avg_authority"), (k * 4.0).alias("conviction"), (k % 7 - 3.0).alias("acceleration"), (k % 5).alias("platforms")).join(counts, "run_id")
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("theme_id"), F.expr(_KIND).alias("event_type"))
    e = e.join(R.investment_signals(e, "theme_id").select("theme_id", F.col("signal").alias("investment_signal")), "theme_id")
    metrics = signals(spark, d).groupBy("theme_id", F.to_date("ts").alias("date")).agg((F.count("*") / 7.0 - 2).alias("volume_zscore"), F.avg("authority").alias("avg_authority"))
    impacts = spark.createDataFrame(_IMPACTS, "source string, target string, impact double")
    out = K.catalysts(runs, e, metrics, impacts)
    return out.select("run_id", "bias", F.round("delta", 6).alias("delta"), F.concat_ws(",", "primary").alias("primary_tickers"), F.concat_ws(",", "related").alias("related_tickers"), F.round("impact_score", 1).alias("impact"), "summary")


RANKED = f"""{BARS}, ret AS (SELECT ticker, date, CASE WHEN lead(date) OVER w <= date + 2 THEN lead(close) OVER w / close - 1 END AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
th AS (SELECT c.date, th.id AS theme_id, 1 + (th.id + extract(day FROM c.date)) % 8 AS rank, [(th.id * 3) % 20, (th.id * 5 + 1) % 20, th.id % 20, 19] AS tickers FROM (SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') c, range(8) th(id)),
b AS (SELECT date, rank, unnest(tickers[1:3]) AS ticker, unnest([1, 2, 3]) AS pos FROM th WHERE rank <= 3), f AS (SELECT date, ticker, min((rank, pos)) AS first FROM b GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first) AS n FROM f),
days AS (SELECT h.date, count(*) AS tickers, avg(r) AS r FROM h LEFT JOIN ret ON ret.date = h.date AND ret.ticker = h.ticker WHERE n <= 5 GROUP BY 1)"""


def _days(spark, d):
    held = bars(spark, d).filter("date between date'1997-01-01' and date'1997-12-31'").select("date").distinct()
    i = F.col("id")
    ranked = held.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("date", i.alias("theme_id"), (1 + (i + F.dayofmonth("date")) % 8).alias("rank"), F.array(i * 3 % 20, (i * 5 + 1) % 20, i % 20, F.lit(19)).cast("array<bigint>").alias("tickers"))
    returns = B.forward_returns(bars(spark, d), [1]).select("date", "ticker", F.col("return_1").alias("r"))
    return B.strategy_days(ranked, returns, 3, 3, 5)


@query(f"WITH {RANKED} SELECT CAST(date AS VARCHAR) AS date, 8 AS themes, tickers, round(r, 6) AS r, r > 0 AS direction_correct FROM days")
def backtest_days(spark, d):
    return _days(spark, d).select(F.col("date").cast("string").alias("date"), "themes", "tickers", F.round("r", 6).alias("r"), "direction_correct")


@query(f"WITH {RANKED} SELECT round(avg((r > 0)::INT), 6) AS hit_rate, count(r) AS days, round(avg(r), 6) AS mean_return, round(stddev_samp(r), 6) AS volatility FROM days")
def backtest_run(spark, d):
    days = _days(spark, d)
    metrics = B.return_metrics(days.withColumn("run", F.lit(1)), ["run"], 1)
    return metrics.join(B.directional_accuracy(days)).select(F.round("hit_rate", 6).alias("hit_rate"), "days", F.round("mean_return", 6).alias("mean_return"), F.round("volatility", 6).alias("volatility"))  # one row each


@query("SELECT o_orderkey, o_orderstatus AS kind FROM orders WHERE o_orderstatus <> 'F'")
def ablation_layers(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderstatus") == "F", "filing").otherwise(F.col("o_orderstatus")).alias("kind"))
    return B.enabled_layers(rows, ["narrative", "structural"]).select("o_orderkey", F.col("s").alias("kind"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR (v AND p IN ('substack', 'news')) THEN 'research' WHEN v THEN 'verified' ELSE 'anonymous' END AS tier, round(least(1.0, CASE WHEN v THEN 0.2 ELSE 0 END + CASE WHEN c_custkey > 0 THEN least(0.3, 0.3 * ln(c_custkey + 1) / ln(1000001)) ELSE 0 END + CASE WHEN c_custkey % 50 > 0 THEN least(0.3, 0.3 * ln(c_custkey % 50 + 1) / ln(10001)) ELSE 0 END + 0.2 * (1 - (c_custkey % 10) / 10.0)), 6) AS authority
FROM (SELECT c_custkey, c_custkey % 3 = 0 AS v, CASE c_nationkey % 3 WHEN 0 THEN 'news' ELSE 'twitter' END AS p FROM customer)""")
def author_tiers(spark, d):
    k = F.col("c_custkey")
    tier = S.author_tier(F.when(k % 4 == 0, F.concat(F.lit(" The TrendForce "), F.col("c_name"))).otherwise(F.col("c_name")), k % 3 == 0, F.when(F.col("c_nationkey") % 3 == 0, "news").otherwise("twitter"))
    return table(spark, d, "customer").select("c_custkey", tier.alias("tier"), F.round(S.document_authority(k % 3 == 0, k, k % 50, (k % 10) / 10.0), 6).alias("authority"))


@query("""WITH p AS (SELECT o_custkey AS author, o_orderpriority AS topic, count(*) FILTER (o_orderstatus = 'O') AS correct, count(*) AS total FROM orders GROUP BY 1, 2)
SELECT author, topic, round(least(1.0, greatest(0.0, ((correct + 2)::DOUBLE / (total + 7) * exp(-0.01 * (author % 100)) * least(1.0, (author % 60) / 30.0) * (1 + author % 3) + least(0.3, 0.3 * log10(1 + author) / 6.0)) / 10.3)), 6) AS score FROM p""")
def topic_authority(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("topic")).agg(F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("correct"), F.count("*").alias("total"))
    a = F.col("author")
    return p.select("author", "topic", F.round(S.author_score(F.col("correct"), F.col("total"), a % 100, a % 60, 1 + a % 3, a), 6).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'contradictory' WHEN o_orderkey % 7 = 0 THEN 'neutral' WHEN o_totalprice > 150000 THEN 'corroborating' WHEN o_totalprice < 150000 THEN 'contradictory' ELSE 'neutral' END AS evidence FROM orders")
def fact_evidence(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, F.when(k % 2 == 0, "restatement").otherwise("margin_compression")).otherwise("revenue_growth")
    return table(spark, d, "orders").select("o_orderkey", S.fact_evidence(kind, F.when(k % 7 != 0, F.col("o_totalprice") - 150000)).alias("evidence"))


@query("SELECT s_suppkey AS theme_id, 'New theme: ' || s_name AS title FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def new_theme_alerts(spark, d):
    now = table(spark, d, "supplier").select(F.col("s_suppkey").alias("theme_id"), F.col("s_name").alias("theme_name"))
    return T.new_themes(now, table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("theme_id"))).select("theme_id", "title")


@query("SELECT event_id, CASE WHEN abs(v) >= 0.1 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN v < 0 THEN 'negative' ELSE 'positive' END AS direction, 'Sentiment change in ''' || event_type || ''' propagated ' || CASE WHEN v < 0 THEN 'negative' ELSE 'positive' END || ' impact of ' || printf('%+.3f', v) || ' to n' || CAST(user_id AS VARCHAR) || ' (' || CAST(h AS VARCHAR) || CASE h WHEN 1 THEN ' hop away)' ELSE ' hops away)' END AS message FROM (SELECT event_id, event_type, user_id, (event_id % 41 - 20) / 130.0 AS v, 1 + event_id % 3 AS h FROM events) WHERE abs(v) >= 0.05")
def propagated_alerts(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("source_theme"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("target"), ((F.col("event_id") % 41 - 20) / 130.0).alias("impact"), (1 + F.col("event_id") % 3).alias("depth"))
    return T.propagated_impacts(e, 0.05).select("event_id", "severity", "direction", "message")


_PLUMBING = "CASE event_type WHEN 'click' THEN 'finra_short_volume' WHEN 'view' THEN 'sec_fail_to_deliver' WHEN 'purchase' THEN 'schedule_13d_ownership' WHEN 'error' THEN '13f_position' ELSE 'form4_non_derivative_transaction' END"
_LEVEL = "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'watch' WHEN 2 THEN 'elevated' ELSE 'extreme' END"


@query(f"""WITH e AS (SELECT event_id, {_PLUMBING} AS kind, {_LEVEL} AS level, CASE WHEN user_id % 3 > 0 THEN 'T' || CAST(user_id AS VARCHAR) END AS ticker, CASE WHEN user_id % 2 = 0 THEN 'c' || CAST(user_id AS VARCHAR) END AS cik FROM events)
SELECT event_id, CASE kind WHEN 'finra_short_volume' THEN 'short_volume_anomaly' WHEN 'sec_fail_to_deliver' THEN 'fails_to_deliver_anomaly' WHEN 'schedule_13d_ownership' THEN 'activist_ownership' WHEN '13f_position' THEN 'institutional_holdings' ELSE 'insider_ownership' END AS signal_class,
 CASE WHEN kind IN ('finra_short_volume', 'sec_fail_to_deliver') THEN CASE level WHEN 'extreme' THEN 'critical' ELSE 'warning' END WHEN kind = 'schedule_13d_ownership' THEN 'warning' ELSE 'info' END AS severity, coalesce(ticker, cik, CAST(event_id AS VARCHAR)) AS subject_id FROM e WHERE NOT (kind IN ('finra_short_volume', 'sec_fail_to_deliver') AND level = 'none')""")
def plumbing_alerts(spark, d):
    e, u = table(spark, d, "events"), F.col("user_id")
    rows = e.select(F.col("event_id"), F.expr(_PLUMBING).alias("event_type"), F.expr(_LEVEL).alias("anomaly_level"), F.when(u % 3 > 0, F.concat(F.lit("T"), u.cast("string"))).alias("ticker"), F.when(u % 2 == 0, F.concat(F.lit("c"), u.cast("string"))).alias("issuer_cik"))
    from ..operators import market as M

    return M.plumbing_signals(rows).select("event_id", "signal_class", "severity", "subject_id")


@query(f"""WITH {CLAIMS}, k AS (SELECT subject, predicate, object, b, sum(confidence * weight) FILTER (link = 'supports') / sum(weight) FILTER (link = 'supports') AS base, count(*) FILTER (link = 'supports') AS supports, count(*) FILTER (link = 'contradicts') AS contradictions, count(DISTINCT source_type) FILTER (link = 'supports') AS source_types, max(published_at) FILTER (link = 'supports') AS last_seen, bool_or(approved) AS ok
 FROM claims, (VALUES (0), (1)) v(b) WHERE status <> 'retracted' AND (b = 1 OR claim_id % 3 <> 0) GROUP BY 1, 2, 3, 4),
a AS (SELECT *, least(1.0, greatest(0.0, coalesce(base, 0) * CASE WHEN last_seen IS NULL THEN 0.5 ELSE exp(-0.01 * greatest(0.0, floor((epoch_us(TIMESTAMP '{AT}') - epoch_us(last_seen)) / 86400000000.0))) END * least(1.0, source_types / 3.0) * (supports::DOUBLE / (supports + contradictions)) + CASE WHEN ok THEN 0.1 ELSE 0 END)) AS confidence,
 CASE WHEN supports = 0 THEN 'retracted' WHEN contradictions > 0 AND supports::DOUBLE / (supports + contradictions) < 0.6 THEN 'disputed' ELSE 'active' END AS status FROM k)
SELECT n.subject, n.predicate, n.object, abs(n.confidence - coalesce(p.confidence, 0)) > 1e-6 AS confidence_changed, n.status <> coalesce(p.status, 'active') AS status_changed, coalesce(p.status, 'active') AS previous_status, n.status AS new_status FROM a n LEFT JOIN a p ON p.b = 0 AND n.subject = p.subject AND n.predicate = p.predicate AND n.object = p.object WHERE n.b = 1""")
def assertion_recompute(spark, d):
    at, c = F.lit(AT).cast("timestamp_ntz"), claims(spark, d)
    out = C.recomputed(C.aggregated(c.filter("claim_id % 3 <> 0"), at, KEY), C.aggregated(c, at, KEY), KEY)
    return out.select(*KEY, "confidence_changed", "status_changed", "previous_status", "new_status")


@query("SELECT l_orderkey * 10 + l_linenumber AS claim_id FROM lineitem WHERE l_suppkey % 3 = 0 AND 1 - l_discount < 0.95")
def high_impact_reviews(spark, d):
    c = claims(spark, d).withColumn("predicate", F.when(F.col("predicate") == "supplies", "supplies_to").otherwise(F.col("predicate")))
    return C.high_impact_reviews(c, 0.95).select("claim_id")


@query("SELECT DISTINCT l_orderkey AS assertion_id FROM lineitem WHERE l_linenumber = 3")
def affected_assertions(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("assertion_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), "l_linenumber")
    return C.affected(li.select("assertion_id", "claim_id"), li.filter("l_linenumber = 3"))


_EV = "CASE event_id % 5 WHEN 0 THEN 'capacity_expansion' WHEN 1 THEN 'capacity_constraint' WHEN 2 THEN 'product_delay' WHEN 3 THEN 'price_change' ELSE 'rumour' END"


@query(f"""WITH e AS (SELECT event_id, user_id, {_EV} AS t, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'Actor ' || CAST(user_id % 9 AS VARCHAR) END AS actor, CASE event_id % 3 WHEN 0 THEN 'is investing' WHEN 1 THEN 'reportedly cuts' ELSE 'expects' END AS action, CASE WHEN event_id % 4 > 0 THEN 'chips' ELSE '' END AS object, CASE event_id % 3 WHEN 0 THEN '$5 billion' WHEN 1 THEN '12 weeks' END AS quantity FROM events),
c AS (SELECT event_id, trim(actor) AS subject, CASE t WHEN 'capacity_expansion' THEN 'expands_capacity' WHEN 'capacity_constraint' THEN 'constrains_capacity' WHEN 'product_delay' THEN 'delays_product' ELSE 'changes_pricing' END AS predicate, nullif(object, '') AS object, CASE event_id % 3 WHEN 0 THEN 5e9 WHEN 1 THEN 12 END::DOUBLE AS value, CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'weeks' END AS unit, t, CASE event_id % 3 WHEN 0 THEN 'reported' WHEN 1 THEN 'rumor' ELSE 'guided' END AS modality FROM e WHERE trim(actor) <> '' AND t <> 'rumour')
SELECT event_id AS doc_id, subject, predicate, object, value AS numeric_value, unit, CASE t WHEN 'price_change' THEN 'price' WHEN 'product_delay' THEN 'product_timing' WHEN 'capacity_expansion' THEN CASE WHEN unit = 'USD' THEN 'capex' ELSE 'capacity' END ELSE CASE WHEN unit = 'weeks' THEN 'lead_time' ELSE 'capacity' END END AS metric, modality, 0.7::DOUBLE AS confidence,
 'ck_' || substr(sha256('narrative' || chr(0) || CAST(event_id AS VARCHAR) || chr(0) || lower(subject) || chr(0) || predicate || chr(0) || coalesce(object, '')), 1, 16) AS claim_key FROM c""")
def event_claims(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        k.alias("doc_id"), F.expr(_EV).alias("event_type"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Actor "), (F.col("user_id") % 9).cast("string"))).alias("actor"), F.when(k % 3 == 0, "is investing").when(k % 3 == 1, "reportedly cuts").otherwise("expects").alias("action"),
        F.when(k % 4 > 0, "chips").otherwise("").alias("object"), F.when(k % 3 == 0, "$5 billion").when(k % 3 == 1, "12 weeks").alias("quantity"), F.lit(None).cast("string").alias("time_ref"), F.lit(None).cast("double").alias("confidence"),
    )
    return C.event_claims(e).select("doc_id", "subject", "predicate", "object", "numeric_value", "unit", "metric", "modality", "confidence", "claim_key")


_PAIRS = "CASE c_custkey % 4 WHEN 0 THEN 'TSMC supplies chips to Nvidia, and they partner.' WHEN 1 THEN 'Intel competes with TSMC.' || repeat(' filler', 60) || ' Nvidia buys' WHEN 2 THEN 'Nvidia and nvidia order wafers' ELSE 'AMD met Intel' END"


@query("""SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 4 WHEN 0 THEN ['TSMC|supplies_to|Nvidia', 'TSMC|depends_on|Nvidia'] WHEN 1 THEN ['TSMC|competes_with|Intel'] ELSE [] END) AS claim FROM customer""")
def cooccurrence_claims(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_PAIRS).alias("content"))
    names = F.array(*[F.lit(x) for x in ("TSMC", "Nvidia", "Intel", "AMD", "nvidia")])
    found = c.select("doc_id", "content", F.posexplode(names).alias("n", "text")).withColumn("start", F.instr("content", F.col("text")) - 1).filter("start >= 0").withColumn("type", F.lit("company"))
    again = found.filter("doc_id % 4 = 0").withColumn("n", F.col("n") + 10)  # named twice: the pair's second verb comes from its second occurrence
    e = found.unionByName(again).select("doc_id", "n", "text", "type", "start")
    out = C.cooccurrence_claims(e, c)
    return out.select("doc_id", F.concat_ws("|", "subject", "predicate", "object").alias("claim"))


@query("SELECT l_orderkey * 10 + l_linenumber AS claim_id, 'sub' || CAST(l_partkey % 9 AS VARCHAR) || ' supplies to' || CASE WHEN l_linenumber % 2 = 0 THEN ' obj' ELSE '' END || CASE WHEN l_quantity > 25 THEN ' price ' || CAST(l_quantity::BIGINT AS VARCHAR) || ' USD' || CASE WHEN l_linenumber = 1 THEN ' (guided)' ELSE '' END ELSE '' END AS text FROM lineitem")
def claim_sentences(spark, d):
    li = table(spark, d, "lineitem")
    t = X.claim_sentence(F.concat(F.lit("sub"), (F.col("l_partkey") % 9).cast("string")), F.lit("supplies_to"), F.when(F.col("l_linenumber") % 2 == 0, "obj"), F.lit("price"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("double")), F.lit("USD"), F.lit(None).cast("string"), F.when(F.col("l_linenumber") == 1, "guided"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), t.alias("text"))


@query("""SELECT n_nationkey, 'mv_' || substr(sha256('{"horizon": ' || CAST(n_regionkey AS VARCHAR) || ', "name": "' || n_name || '"}'), 1, 12) AS version FROM nation""")
def version_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.version_id(("name", F.col("n_name")), ("horizon", F.col("n_regionkey"))).alias("version"))


@query("""WITH a AS (SELECT o_custkey AS run_id, count(*) AS n, count(DISTINCT o_orderstatus) AS p, avg(o_totalprice) / 1e5 AS s FROM orders GROUP BY 1), b AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN run_id % 7 = 0 THEN p + 1 ELSE p END AS p, CASE WHEN run_id % 3 = 0 THEN s + 0.02 ELSE s + 0.001 END AS s FROM a WHERE run_id % 11 <> 0)
SELECT run_id, CASE WHEN b.n IS NULL THEN 'missing' ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'doc_count' END, CASE WHEN a.p <> b.p THEN 'platform_count' END, CASE WHEN abs(a.s - b.s) > 0.01 THEN 'avg_sentiment' END) END AS issues, coalesce(a.n = b.n AND a.p = b.p AND abs(a.s - b.s) <= 0.01, false) AS passed FROM a LEFT JOIN b USING (run_id)""")
def backfill_stability(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("doc_count"), F.countDistinct("o_orderstatus").alias("platform_count"), (F.avg("o_totalprice") / 1e5).alias("avg_sentiment"), F.lit(0.5).alias("avg_authority"))
    k = F.col("run_id")
    b = a.filter(k % 11 != 0).withColumns({"doc_count": F.when(k % 5 == 0, F.col("doc_count") + 1).otherwise(F.col("doc_count")), "platform_count": F.when(k % 7 == 0, F.col("platform_count") + 1).otherwise(F.col("platform_count")), "avg_sentiment": F.col("avg_sentiment") + F.when(k % 3 == 0, 0.02).otherwise(0.001)})
    return P.backfill_issues(a, b)


@query("SELECT event_id, event_id % 3 > 0 OR greatest((event_id % 10) / 10.0, (user_id % 10) / 10.0) > 0.3 AS covered, abs((event_id % 100) - (user_id % 100)) <= 20 AS agrees FROM events")
def replay_checks(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select("event_id", P.replay_covered(e % 3 == 0, (e % 10) / 10.0, (u % 10) / 10.0).alias("covered"), P.conviction_agrees(e % 100, u % 100).alias("agrees"))


@query("""WITH r AS (SELECT user_id AS run_id, max(ts) AS last, CASE user_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'cooling' ELSE 'closed' END AS status FROM events GROUP BY 1)
SELECT run_id, CASE WHEN status <> 'closed' AND last < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR THEN 'closed' WHEN status = 'active' AND last < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2 HOUR THEN 'cooling' ELSE status END AS status FROM r""")
def run_maintenance(spark, d):
    status = F.when(F.col("user_id") % 3 == 0, "active").when(F.col("user_id") % 3 == 1, "cooling").otherwise("closed")
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id"), status.alias("status")).agg(F.max("ts").alias("last_document_at")).withColumn("closed_at", F.lit(None).cast("timestamp_ntz"))
    return P.maintained(runs, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("run_id", "status")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_partkey AS run_id, max(l_shipdate) AS seen, max(CASE l_returnflag WHEN 'R' THEN 'closed' WHEN 'N' THEN 'active' ELSE 'cooling' END) AS status, max(l_quantity) / 50.0 AS sim FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seen DESC, run_id) AS n FROM c)
SELECT doc_id, arg_max(run_id, sim * 1000 - n) AS run_id FROM r WHERE n <= 5 AND status <> 'closed' AND NOT (status = 'cooling' AND seen < TIMESTAMP '1995-01-01') AND sim >= 0.5 GROUP BY 1""")
def run_selection(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "closed").when(F.col("l_returnflag") == "N", "active").otherwise("cooling")
    lines = table(spark, d, "lineitem")
    # dealt by document once: the grouping, the window and the choice need no other exchange, and a task's share doesn't grow
    c = lines.repartition(parts(lines), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("run_id")).agg(F.max("l_shipdate").alias("last_document_at"), F.max(status).alias("status"), (F.max("l_quantity") / 50.0).alias("similarity"))
    return P.selected_runs(c, 0.5, F.lit("1995-01-02 00:00:00").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id % 40 AS run, CASE WHEN event_id % 6 = 0 THEN 'passage_too_short' WHEN event_id % 7 = 0 THEN 'predicate_not_high_value' END AS rule FROM events), a2 AS (SELECT *, CAST(day AS VARCHAR) || '-' || CAST(run AS VARCHAR) AS key FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM a2 WHERE rule IS NULL), w AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM o WHERE k <= 2), s AS (SELECT day, (ts, event_id) AS last FROM w WHERE n = 20)
SELECT a2.event_id AS id, CASE WHEN a2.rule IS NOT NULL THEN a2.rule WHEN s.last IS NOT NULL AND (a2.ts, a2.event_id) > s.last THEN 'daily_budget_exhausted' WHEN o.k > 2 THEN 'run_budget_exhausted' END AS deny_reason FROM a2 LEFT JOIN o USING (event_id) LEFT JOIN s ON s.day = a2.day""")
def fallback_gate(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(k.alias("id"), F.col("ts").alias("asked_at"), F.when(k % 6 == 0, 10).otherwise(500).alias("passage_length"), F.when(k % 7 == 0, "mentions").when(k % 2 == 0, "acquires").alias("predicate"), F.concat(F.to_date("ts").cast("string"), F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("run_id"))
    return P.fallback_gate(rows, True, 50, ["acquires"], 20, 2).select("id", "deny_reason")
