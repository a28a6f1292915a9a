"""Ratio checks, freshness budgets, drift of daily figures, triggers, comparisons with a base line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scoring as S

# Warning, critical, whether a higher share is better
CHECKS = {
    "lineage_completeness": (0.95, 0.85, True),
    "unresolved_entities": (0.05, 0.15, False),
    "filing_parse_quality": (0.90, 0.75, True),
    "stale_evidence": (0.10, 0.25, False),
}
BUDGET_HOURS = {"narrative": 6.0, "filing": 72.0, "structural": 24.0, "backtest": 168.0}
BUDGET_DEFAULT, BUDGET_WARNING, NEVER = 24.0, 0.75, 999.0
LEVELS = ("ok", "warning", "critical")


def ratio_checks(rows: DataFrame, key: str, hits: dict[str, Column]) -> DataFrame:
    """(key, check, value, severity) for each named check: the share of a key's rows that hit, in one pass; null counts as no hit."""
    shares = rows.groupBy(key).agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in hits.items()])
    out = shares.unpivot([key], list(hits), "check", "value")
    severity = None
    for name in hits:
        warning, critical, better = CHECKS[name]
        found = S.level(F.col("value"), warning, critical, higher_is_worse=False) if better else S.error_level(F.col("value"), F.lit(warning), F.lit(critical))
        severity = (F.when if severity is None else severity.when)(F.col("check") == name, found)
    return out.withColumn("severity", severity)


def worst(checks: DataFrame, key: str) -> DataFrame:
    """The worst severity of each key."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    return checks.groupBy(key).agg(F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.max(rank).cast("int")).alias("severity"))


def freshness_budgets(runs: DataFrame, lanes: DataFrame, at: Column) -> DataFrame:
    """By lane: the share of its budget used since its last completed run (999 without one), and the severity."""
    last = runs.groupBy("lane").agg(F.max("completed_at").alias("last"))
    budget = F.coalesce(reduce(lambda a, b: F.coalesce(a, b), [F.when(F.col("lane") == k, v) for k, v in BUDGET_HOURS.items()]), F.lit(BUDGET_DEFAULT))
    rows = lanes.select("lane").distinct().join(last, "lane", "left").withColumn("budget", budget)
    hours = F.greatest(F.lit(0.0), (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(3_600_000_000.0))
    severity = F.when(F.col("last").isNull(), "critical").otherwise(S.error_level(hours, F.col("budget") * BUDGET_WARNING, F.col("budget")))
    used = F.when(F.col("last").isNull(), NEVER).otherwise(F.round(hours / F.col("budget"), 4))
    return rows.select("lane", used.alias("value"), severity.alias("severity"))


def latest_daily_count(rows: DataFrame, day: str, warning: float, critical: float) -> DataFrame:
    """One row: the last day, its number of rows, the severity (more is worse)."""
    daily = rows.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    return daily.agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n")).withColumn("severity", S.level(F.col("n"), warning, critical))


def calibration_shift(rows: DataFrame, key: str, day: str, value: str, warning: float, critical: float) -> DataFrame:
    """By key and day: how far the day's mean is from the earlier days' mean, in their deviations; 0 with fewer than two earlier days or no spread."""
    daily = rows.filter(F.col(value).isNotNull()).groupBy(key, F.to_date(day).alias("day")).agg(F.avg(value).alias("mean"))
    before = W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    n, m, s = F.count("mean").over(before), F.avg("mean").over(before), F.stddev_pop("mean").over(before)
    z = F.when((n < 2) | (s < 1e-10), 0.0).otherwise(F.abs(F.col("mean") - m) / s)
    return daily.withColumn("zscore", z).withColumn("severity", S.level(F.col("zscore"), warning, critical))


def fired(metrics: DataFrame, triggers: DataFrame) -> DataFrame:
    """(lane, trigger, action, value, threshold) of the triggers whose metric is beyond its threshold; a lane without the metric fires none.

    triggers: trigger, metric, threshold, above (fires above or below), action.
    """
    rows = metrics.filter("value is not null").join(triggers, "metric")
    return rows.filter(F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))).select("lane", "trigger", "action", "value", "threshold")


def baseline_deltas(metrics: DataFrame, baseline: str, variants: list[str]) -> DataFrame:
    """(variant, metric, delta) of the named variants against the base line; a metric that either lacks counts as 0, one that both lack gives no row."""
    names = F.array(*[F.lit(v) for v in variants])
    own = F.map_from_entries(F.collect_list(F.when(F.col("variant").isin(variants), F.struct("variant", "value"))))
    rows = metrics.groupBy("metric").agg(F.max(F.when(F.col("variant") == baseline, F.col("value"))).alias("_b"), own.alias("_own"))
    each = rows.select("metric", "_b", "_own", F.explode(names).alias("variant")).withColumn("value", F.try_element_at("_own", F.col("variant")))
    return each.filter("value is not null or _b is not null").select("variant", "metric", (F.coalesce("value", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("delta"))


def parity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, rows): how many rows, with repeats, only one of the two has."""
    one = lambda a, b, name: a.exceptAll(b.select(*a.columns)).agg(F.lit(name).alias("side"), F.count("*").alias("rows"))
    return one(expected, actual, "missing").union(one(actual.select(*expected.columns), expected, "unexpected"))


def feed_health(fetches: DataFrame) -> DataFrame:
    """(feed, status, error, failures) from fetches (feed, at, status, error): the last fetch's, and how many have failed since the last that didn't."""
    bad = F.col("status").isin("error", "parse_failure")
    last = fetches.groupBy("feed").agg(F.max_by(F.struct("status", "error"), "at").alias("_l"), F.max(F.when(~bad, F.col("at"))).alias("_ok"))
    failures = fetches.filter(bad).join(last.select("feed", "_ok"), "feed").filter("_ok is null or at > _ok").groupBy("feed").agg(F.count("*").alias("failures"))
    return last.join(failures, "feed", "left").select("feed", "_l.status", "_l.error", F.coalesce("failures", F.lit(0)).alias("failures"))
