"""Backtests: forward returns, return metrics, drawdown, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import parts, table

TRADING_DAYS = 252.0


def forward_returns(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """For every bar (ticker, date, close): the h-th next bar's close / close - 1, null beyond the data or 2 * max horizon days."""
    by = W.partitionBy("ticker").orderBy("date")
    far = F.date_add("date", 2 * max(horizons))
    return bars.select("ticker", "date", "close", *[F.when(F.lead("date", h).over(by) <= far, F.lead("close", h).over(by) / F.col("close") - 1).alias(f"return_{h}") for h in horizons])


def return_metrics(daily: DataFrame, key: list[str], horizon: int, value: str = "r") -> DataFrame:
    """Mean, cumulative, extremes, volatility, Sharpe, Sortino, win rate, profit factor by key; nulls don't count."""
    r, n = F.col(value), F.count(value)
    a = TRADING_DAYS / horizon
    down = F.stddev_samp(F.when(r < 0, r))
    spread, mean = F.stddev_samp(r), F.avg(r)
    lost = F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    return daily.groupBy(*key).agg(
        n.alias("days"), mean.alias("mean_return"), (F.exp(F.sum(F.log1p(r))) - 1).alias("cumulative_return"), F.max(r).alias("best"), F.min(r).alias("worst"), spread.alias("volatility"),
        F.when((n >= 2) & (spread > 0), mean * a / (spread * F.sqrt(F.lit(a)))).alias("sharpe"),
        F.when((F.count(F.when(r < 0, r)) >= 2) & (down > 0), mean * a / (down * F.sqrt(F.lit(a)))).alias("sortino"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("win_rate"),
        F.when(lost > 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / lost).alias("profit_factor"),
    )


def max_drawdown(daily: DataFrame, key: list[str], value: str = "r") -> DataFrame:
    """Least (wealth - running maximum) / running maximum; the maximum starts at the first wealth."""
    by = W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    wealth = daily.withColumn("_wealth", F.exp(F.sum(F.log1p(F.col(value))).over(by)))
    return wealth.withColumn("_fall", F.col("_wealth") / F.max("_wealth").over(by) - 1).groupBy(*key).agg(F.min("_fall").alias("max_drawdown"))


def calibration(rows: DataFrame, score: str, outcome: str, n_buckets: int, order: list[str], key: list[str]) -> DataFrame:
    """Equal-count buckets by score within key, boundaries rounded half to even: mean score and outcome of each.

    A key with fewer than n_buckets rows has none.  A key's rows are dealt into cells by ranges of the order: most cells lie within
    one bucket and are summed as they are, and of those that an edge cuts only the rows are numbered, cell by cell, so no task
    holds a key.  Rows equal in the whole order lie in one cell.
    """
    # written, as both readings must see the same ranges
    placed = table(rows.select(*key, score, outcome, *order).repartitionByRange(parts(rows), *key, score, *order).withColumn("_cell", F.spark_partition_id()))
    cells = placed.groupBy(*key, "_cell").agg(F.count("*").alias("_n"))
    by = W.partitionBy(*key)  # as many rows as cells
    sized = cells.select("*", F.sum("_n").over(by).alias("_all"), (F.sum("_n").over(by.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before")).filter(F.col("_all") >= n_buckets)
    edge = lambda b: F.rint(F.lit(float(b)) * F.col("_all") / n_buckets)
    bucket = lambda i: sum((F.when(i >= edge(b), 1).otherwise(0) for b in range(1, n_buckets)), F.lit(0))
    sized = sized.select("*", bucket(F.col("_before")).alias("_low"), bucket(F.col("_before") + F.col("_n") - 1).alias("_high"))
    same = F.lit(True)
    for k in key:
        same &= F.col(f"_{k}").eqNullSafe(F.col(k))
    known = placed.join(F.broadcast(sized.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_cell").alias("_of"), "_all", "_before", "_low", "_high")), (F.col("_cell") == F.col("_of")) & same)
    whole = known.filter("_low = _high").withColumn("bucket", F.col("_low"))
    i = F.col("_before") + F.row_number().over(W.partitionBy(*key, "_cell").orderBy(score, *order)) - 1
    cut = known.filter("_low < _high").withColumn("bucket", bucket(i))
    return whole.unionByName(cut).groupBy(*key, "bucket").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(outcome).alias("mean_outcome"))


def trading_days(spark, first: str, last: str) -> DataFrame:
    return spark.sql(f"select explode(sequence(date '{first}', date '{last}', interval 1 day)) as date").filter(F.weekday("date") < 5)


def as_of_rows(calendar: DataFrame, metrics: DataFrame, key: str, lookback_days: int) -> DataFrame:
    """For every calendar date and key the latest metric row of the lookback: each row is given to the dates that see it."""
    rows = metrics.withColumn("metric_date", F.col("date")).drop("date")
    seen = rows.withColumn("date", F.explode(F.sequence("metric_date", F.date_add("metric_date", lookback_days), F.expr("interval 1 day"))))
    last = W.partitionBy(key, "date").orderBy(F.desc("metric_date"))
    return seen.join(F.broadcast(calendar), "date", "left_semi").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def strategy_days(ranked: DataFrame, returns: DataFrame, top: int, per_theme: int = 3, most: int = 20) -> DataFrame:
    """(date, themes, tickers, r, direction_correct) of every day with ranked themes: all days at once.

    ranked: date, theme_id, rank, tickers (best first).  The first ``per_theme`` tickers of
    the first ``top`` themes count, each once, in that order up to ``most``; returns:
    date, ticker, r (null where unknown).  r is their mean, null if none is known.
    """
    days = ranked.groupBy("date").agg(F.count("*").alias("themes"))
    best = ranked.filter(F.col("rank") <= top).select("date", "rank", F.posexplode(F.slice("tickers", 1, per_theme)).alias("_at", "ticker"))
    once = best.groupBy("date", "ticker").agg(F.min(F.struct("rank", "_at")).alias("_first"))
    chosen = once.withColumn("_n", F.row_number().over(W.partitionBy("date").orderBy("_first"))).filter(F.col("_n") <= most)  # at most top * per_theme a day
    held = chosen.join(returns, ["date", "ticker"], "left").groupBy("date").agg(F.count("*").alias("tickers"), F.avg("r").alias("r"))
    out = days.join(held, "date", "left")
    return out.select("date", "themes", F.coalesce("tickers", F.lit(0)).alias("tickers"), "r", F.when(F.col("r").isNotNull(), F.col("r") > 0).alias("direction_correct"))


def directional_accuracy(days: DataFrame) -> DataFrame:
    """Share of days whose direction was right among those where it is known; null if none is."""
    return days.agg(F.avg(F.col("direction_correct").cast("double")).alias("hit_rate"))


def enabled_layers(objects: DataFrame, layers: list[str]) -> DataFrame:
    """Snapshot rows (kind) without the artifacts of layers that are off; filings are the only ones that a layer owns."""
    return objects if "filing" in layers else objects.filter("kind <> 'filing'")
