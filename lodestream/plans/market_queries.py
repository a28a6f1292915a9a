"""Queries on factors, market structure, filings, prices: orders and lineitem stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B, factors as A, market as M
from .bind import table
from .registry import query

OBS = """obs AS (SELECT o_orderpriority AS factor_id, date_trunc('month', o_orderdate)::DATE AS observation_date, date_trunc('month', o_orderdate) + (30 + 10 * v) * INTERVAL 1 DAY AS available_at, date_trunc('month', o_orderdate) + (31 + 10 * v) * INTERVAL 1 DAY AS fetched_at, v AS revision, sum(CASE WHEN o_orderkey % 7 >= v THEN o_totalprice ELSE 0 END) AS value FROM orders, (VALUES (0), (1)) t(v) GROUP BY 1, 2, 3, 4, 5)"""


def observations(spark, d):
    o = table(spark, d, "orders").withColumn("revision", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", F.date_trunc("month", "o_orderdate"))
    day = lambda n: F.date_add(F.to_date("m"), n).cast("timestamp_ntz")
    return o.groupBy(F.col("o_orderpriority").alias("factor_id"), F.to_date("m").alias("observation_date"), day(30 + 10 * F.col("revision")).alias("available_at"), day(31 + 10 * F.col("revision")).alias("fetched_at"), "revision").agg(F.sum(F.when(F.col("o_orderkey") % 7 >= F.col("revision"), F.col("o_totalprice")).otherwise(0.0)).alias("value"))


_ASOF = f"""{OBS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, observation_date ORDER BY available_at DESC, fetched_at DESC) AS n FROM obs WHERE available_at <= TIMESTAMP '1998-06-15 00:00:00') WHERE n = 1)"""
AT = "1998-06-15 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@query(f"WITH {_ASOF} SELECT factor_id, CAST(observation_date AS VARCHAR) AS observation_date, revision, round(value, 2) AS value FROM a")
def factor_asof(spark, d):
    return A.as_of(observations(spark, d), _at()).select("factor_id", F.col("observation_date").cast("string").alias("observation_date"), "revision", F.round("value", 2).alias("value"))


_REGIME = "CASE WHEN value IS NULL THEN 'missing' WHEN previous IS NULL OR previous = 0 THEN 'observed' WHEN abs((value - previous) / abs(previous)) < 0.01 THEN 'stable' WHEN value > previous THEN 'rising' ELSE 'falling' END"


@query(f"WITH {_ASOF}, p AS (SELECT *, lag(value) OVER (PARTITION BY factor_id ORDER BY observation_date) AS previous FROM a) SELECT factor_id, CAST(observation_date AS VARCHAR) AS observation_date, {_REGIME} AS regime FROM p")
def factor_regime(spark, d):
    return A.with_regime(A.as_of(observations(spark, d), _at())).select("factor_id", F.col("observation_date").cast("string").alias("observation_date"), "regime")


@query(f"""WITH {_ASOF}, l AS (SELECT factor_id, arg_max(value, observation_date) AS value, arg_min(value, observation_date) AS previous, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY observation_date DESC) AS j FROM a) WHERE j <= 2 GROUP BY 1),
p AS (SELECT t.theme_id, l.factor_id, (t.theme_id % 2 = 0 AND l.factor_id LIKE '%H%')::INT + (t.theme_id % 3 = 0 AND l.factor_id LIKE '%O%')::INT AS shared_tags, value, previous FROM range(10) t(theme_id), l)
SELECT theme_id, factor_id, shared_tags::BIGINT AS shared_tags, {_REGIME} AS regime, rank FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY shared_tags DESC, factor_id) AS rank FROM p WHERE shared_tags > 0) WHERE rank <= 5""")
def factor_context(spark, d):
    tags = lambda a, b: F.array_compact(F.array(F.when(a, F.lit("h")), F.when(b, F.lit("o"))))
    themes = spark.range(10).select(F.col("id").alias("theme_id"), tags(F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("tags"))
    obs = observations(spark, d)
    series = obs.select("factor_id").distinct().select("factor_id", tags(F.col("factor_id").contains("H"), F.col("factor_id").contains("O")).alias("tags"))
    return A.theme_context(themes, series, obs, _at()).select("theme_id", "factor_id", "shared_tags", "regime", "rank")


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN last_day(o_orderdate) WHEN 1 THEN (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE WHEN 2 THEN make_date(year(o_orderdate), 12, 31) ELSE o_orderdate::DATE END + 15 AS VARCHAR) AS available_on FROM orders""")
def factor_availability(spark, d):
    cadence = F.element_at(F.array(*[F.lit(x) for x in ("monthly", "quarterly", "annual", "daily")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(A.available_at(cadence, day, F.lit(15), F.lit(None).cast("timestamp"))).cast("string").alias("available_on"))


EVENTS = """ev AS (SELECT 's' || CAST(l_suppkey % 40 AS VARCHAR) AS symbol, l_shipdate::DATE AS day, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_volume, sum(l_quantity) AS total_volume FROM lineitem WHERE extract(year FROM l_shipdate) = 1997 GROUP BY 1, 2),
lv AS (SELECT *, short_volume / total_volume AS ratio, CASE WHEN short_volume / total_volume >= 0.75 THEN 'extreme' WHEN short_volume / total_volume >= 0.5 THEN 'watch' ELSE 'none' END AS level FROM ev)"""


@query(f"""WITH {EVENTS}, b AS (SELECT *, lag(day) OVER w AS pd, lag(level) OVER w AS pl FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY day)),
g AS (SELECT *, coalesce(pd IS NOT NULL AND day > pd + CASE isodow(pd) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AND pl <> 'none' AND level <> 'none', FALSE) AS gap FROM b),
i AS (SELECT *, sum(CASE WHEN level = 'none' OR pd IS NULL OR pl = 'none' OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day) AS island FROM g)
SELECT symbol, CAST(day AS VARCHAR) AS day, round(ratio, 4) AS ratio, level, CASE WHEN level = 'none' THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY day) END AS persistence, CASE WHEN gap THEN 'gap' END AS reset_reason FROM i""")
def short_volume_persistence(spark, d):
    li = table(spark, d, "lineitem").filter(F.year("l_shipdate") == 1997)
    ev = li.groupBy(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("s"), F.sum("l_quantity").alias("t"))
    ev = ev.withColumn("ratio", F.col("s") / F.col("t")).withColumn("level", M.short_level(F.col("ratio")))
    return M.persistence(ev, ["symbol"]).select("symbol", F.col("day").cast("string").alias("day"), F.round("ratio", 4).alias("ratio"), "level", F.col("persistence").cast("long").alias("persistence"), "reset_reason")


@query("SELECT l_partkey % 100 AS symbol, round(sum(l_extendedprice), 2) AS notional, CASE WHEN sum(l_extendedprice) >= 1e7 THEN 'extreme' WHEN sum(l_extendedprice) >= 1e6 THEN 'watch' ELSE 'none' END AS level FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def ftd_levels(spark, d):
    out = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy((F.col("l_partkey") % 100).alias("symbol")).agg(F.sum("l_extendedprice").alias("v"))
    return out.select("symbol", F.round("v", 2).alias("notional"), M.ftd_level(F.col("v")).alias("level"))


FACTS = """facts AS (SELECT o_custkey % 50 AS cik, o_orderstatus AS fact, date_trunc('quarter', o_orderdate)::DATE AS period_end, o_orderdate::DATE AS filed, o_orderkey AS accession, round(o_totalprice / 1000) AS value FROM orders)"""
_KEY = ["cik", "fact"]


def facts(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("cik"), F.col("o_orderstatus").alias("fact"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accession"), F.round(F.col("o_totalprice") / 1000).alias("value"))


_LAST = f"{FACTS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, fact, period_end ORDER BY filed DESC, accession DESC) AS n FROM facts) WHERE n = 1)"


@query(f"""WITH {_LAST}, p AS (SELECT *, lag(value) OVER (PARTITION BY cik, fact ORDER BY period_end, filed, accession) AS previous FROM last)
SELECT cik, fact, CAST(period_end AS VARCHAR) AS period_end, value, previous, value - previous AS delta, round(CASE WHEN previous <> 0 THEN (value - previous) / previous END, 6) AS relative, CAST(filed AS VARCHAR) AS available_on FROM p WHERE previous IS NOT NULL AND previous <> value""")
def fact_delta(spark, d):
    return M.fact_deltas(facts(spark, d), _KEY).select("cik", "fact", F.col("period_end").cast("string").alias("period_end"), "value", "previous", "delta", F.round("relative", 6).alias("relative"), F.to_date("available_at").cast("string").alias("available_on"))


@query(f"""WITH {FACTS}, p AS (SELECT *, lag(value) OVER (PARTITION BY cik, fact, period_end ORDER BY filed, accession) AS previous FROM facts) SELECT cik, fact, accession, previous, value FROM p WHERE previous IS NOT NULL AND previous <> value""")
def restatements(spark, d):
    return M.restatements(facts(spark, d), _KEY).select("cik", "fact", "accession", "previous", "value")


@query(f"""WITH {_LAST}, j AS (SELECT a.cik, a.period_end, a.value / b.value AS margin FROM last a JOIN last b ON a.cik = b.cik AND a.period_end = b.period_end WHERE a.fact = 'P' AND b.fact = 'F' AND b.value <> 0), c AS (SELECT *, margin - lag(margin) OVER (PARTITION BY cik ORDER BY period_end) AS change FROM j)
SELECT cik, CAST(period_end AS VARCHAR) AS period_end, round(margin, 6) AS margin, round(change, 6) AS change, coalesce(change < 0, FALSE) AS compressed FROM c""")
def margin_events(spark, d):
    last = M.latest_per_period(facts(spark, d), _KEY)
    out = M.margins(last.filter("fact = 'P'"), last.filter("fact = 'F'"), ["cik"])
    return out.select("cik", F.col("period_end").cast("string").alias("period_end"), F.round("margin", 6).alias("margin"), F.round("change", 6).alias("change"), "compressed")


@query("""WITH m AS (SELECT l_suppkey % 30 AS issuer, l_returnflag AS dimension, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2), p AS (SELECT a.issuer, a.dimension, a.m, avg(b.m) AS pm, coalesce(stddev_samp(b.m), 0) AS ps FROM m a LEFT JOIN m b ON a.dimension = b.dimension AND a.issuer <> b.issuer GROUP BY 1, 2, 3)
SELECT issuer, dimension, round(m, 6) AS magnitude, round(CASE WHEN pm IS NULL OR abs(m - pm) < 1e-10 THEN 0.0 WHEN ps < 1e-10 THEN sign(m - pm) * 3.0 ELSE greatest(-3.0, least(3.0, (m - pm) / ps)) END, 4) AS z, abs(CASE WHEN pm IS NULL OR abs(m - pm) < 1e-10 THEN 0.0 WHEN ps < 1e-10 THEN 3.0 ELSE greatest(-3.0, least(3.0, (m - pm) / ps)) END) >= 1.5 AS unusual FROM p""")
def filing_drift(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("issuer"), F.col("l_returnflag").alias("dimension"), F.col("l_discount").alias("magnitude"))
    return M.drift_against_peers(c).select("issuer", "dimension", F.round("m", 6).alias("magnitude"), F.round("z", 4).alias("z"), "unusual")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, 's' || CAST(l_suppkey * 2 AS VARCHAR) AS symbol FROM lineitem), s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey AS security_id, s_name AS security_name FROM supplier)
SELECT l_orderkey, l_linenumber, symbol, coalesce(security_id, -1) AS security_id, coalesce(security_name, symbol) AS security_name, CASE WHEN security_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS mapping_status FROM e LEFT JOIN s USING (symbol)""")
def security_mapping_left(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), (F.col("l_suppkey") * 2).cast("string")).alias("symbol"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("security_name"))
    return M.with_security(e, s).select("l_orderkey", "l_linenumber", "symbol", F.coalesce("security_id", F.lit(-1)).alias("security_id"), "security_name", "mapping_status")


_SNAP = "n AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 4 <> 0), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'old ' || p_name ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0)"


@query(f"WITH {_SNAP} SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'deactivate' WHEN n.name <> o.name THEN 'update' ELSE 'keep' END AS action FROM n FULL JOIN o ON n.k = o.k")
def directory_reconciliation(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    old = p.filter("k % 3 <> 0").withColumn("name", F.when(F.col("k") % 5 == 0, F.concat(F.lit("old "), "name")).otherwise(F.col("name")))
    return M.reconciled(p.filter("k % 4 <> 0"), old, ["k"])


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.005 ELSE 3 END AS v FROM orders WHERE o_orderkey % 13 <> 0)
SELECT k, severity FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing_in_shadow' WHEN a.k IS NULL THEN 'missing_in_current' WHEN a.v = b.v THEN NULL WHEN abs(a.v - b.v) <= 0.01 THEN 'minor' ELSE 'material' END AS severity FROM a FULL JOIN b ON a.k = b.k) WHERE severity IS NOT NULL""")
def keyed_diff_full_outer(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    shadow = o.filter("k % 13 <> 0").withColumn("v", F.col("v") + F.when(F.col("k") % 4 == 0, 0.0).when(F.col("k") % 4 == 1, 0.005).otherwise(3.0))
    return M.keyed_diff(o.filter("k % 11 <> 0"), shadow, ["k"], "v", 0.01).select("k", "severity")


BARS = "bars AS (SELECT l_suppkey % 20 AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2)"


def bars(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


@query(f"""WITH {BARS} SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN lead(date, 1) OVER w <= date + 10 THEN lead(close, 1) OVER w / close - 1 END, 5) AS return_1, round(CASE WHEN lead(date, 5) OVER w <= date + 10 THEN lead(close, 5) OVER w / close - 1 END, 5) AS return_5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def forward_returns(spark, d):
    return B.forward_returns(bars(spark, d), [1, 5]).select("ticker", F.col("date").cast("string").alias("date"), F.round("return_1", 5).alias("return_1"), F.round("return_5", 5).alias("return_5"))


RETURNS = f"{BARS}, ret AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM bars)"


def _returns(spark, d):
    return B.forward_returns(bars(spark, d), [1]).withColumn("r", F.col("return_1"))


@query(f"""WITH {BARS}, ret AS (SELECT ticker, date, CASE WHEN lead(date) OVER w <= date + 2 THEN lead(close) OVER w / close - 1 END AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, count(r) AS days, round(avg(r), 6) AS mean_return, round(max(r), 6) AS best, round(min(r), 6) AS worst, round(stddev_samp(r), 6) AS volatility, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252.0)), 5) AS sharpe, round(avg(r) * 252 / (stddev_samp(r) FILTER (r < 0) * sqrt(252.0)), 5) AS sortino, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS win_rate, round(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)), 5) AS profit_factor FROM ret GROUP BY 1""")
def backtest_metrics(spark, d):
    out = B.return_metrics(_returns(spark, d), ["ticker"], 1)
    return out.select("ticker", "days", *[F.round(c, 6).alias(c) for c in ("mean_return", "best", "worst", "volatility")], F.round("sharpe", 5).alias("sharpe"), F.round("sortino", 5).alias("sortino"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 5).alias("profit_factor"))


_W = f"""{BARS}, ret AS (SELECT ticker, date, CASE WHEN lead(date) OVER w <= date + 2 THEN lead(close) OVER w / close - 1 END AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), wl AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY ticker ORDER BY date)) AS wealth FROM ret)"""


@query(f"WITH {_W} SELECT ticker, round(min(fall), 6) AS max_drawdown FROM (SELECT ticker, wealth / max(wealth) OVER (PARTITION BY ticker ORDER BY date) - 1 AS fall FROM wl) GROUP BY 1")
def max_drawdown(spark, d):
    return B.max_drawdown(_returns(spark, d).fillna({"r": 0.0}), ["ticker"]).select("ticker", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("""WITH r AS (SELECT l_returnflag AS k, l_discount AS s, l_tax AS o, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
b AS (SELECT *, (i >= round_even(1.0 * n / 3, 0))::INT + (i >= round_even(2.0 * n / 3, 0))::INT AS bucket FROM r) SELECT k, bucket, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(o), 6) AS mean_outcome FROM b GROUP BY 1, 2""")
def calibration_buckets(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("s"), F.col("l_tax").alias("o"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return B.calibration(rows, "s", "o", 3, ["l_orderkey", "l_linenumber"], ["k"]).select("k", "bucket", "n", F.round("mean_score", 6).alias("mean_score"), F.round("mean_outcome", 6).alias("mean_outcome"))


@query(f"""WITH {BARS}, c AS (SELECT x::DATE AS date FROM generate_series(TIMESTAMP '1997-03-01', TIMESTAMP '1997-03-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)
SELECT b.ticker, CAST(c.date AS VARCHAR) AS date, CAST(max(b.date) AS VARCHAR) AS metric_date, round(arg_max(b.close, b.date), 2) AS close FROM c JOIN bars b ON b.date <= c.date AND b.date >= c.date - 7 GROUP BY 1, c.date""")
def point_in_time_metrics(spark, d):
    out = B.as_of_rows(B.trading_days(spark, "1997-03-01", "1997-03-31"), bars(spark, d), "ticker", 7)
    return out.select("ticker", F.col("date").cast("string").alias("date"), F.col("metric_date").cast("string").alias("metric_date"), F.round("close", 2).alias("close"))


@query("WITH m AS (SELECT l_returnflag AS metric, avg(l_discount) AS value FROM lineitem GROUP BY 1) SELECT g.metric, coalesce(m.value >= g.least, FALSE) AS passed FROM (VALUES ('A', 0.04), ('N', 0.9), ('X', 0.0)) g(metric, least) LEFT JOIN m USING (metric)")
def cutover_gates(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg("l_discount").alias("value"))
    return M.gates(m, spark.createDataFrame([("A", 0.04), ("N", 0.9), ("X", 0.0)], "metric string, least double")).select("metric", "passed")
