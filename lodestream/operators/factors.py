"""Bitemporal factor observations: vintages as of a time, regimes, period ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def as_of(observations: DataFrame, at: Column, per_factor: int | None = None) -> DataFrame:
    """The latest vintage available at ``at`` of each (factor_id, observation_date); of each factor the last per_factor dates."""
    seen = observations.filter(F.col("available_at") <= at)
    out = seen.withColumn("_n", F.row_number().over(W.partitionBy("factor_id", "observation_date").orderBy(F.desc("available_at"), F.desc("fetched_at")))).filter("_n = 1").drop("_n")
    if per_factor is None:
        return out
    return out.withColumn("_k", F.row_number().over(W.partitionBy("factor_id").orderBy(F.desc("observation_date")))).filter(F.col("_k") <= per_factor).drop("_k")


def regime(value: Column, previous: Column, threshold: float = 0.01) -> Column:
    change = (value - previous) / F.abs(previous)
    return F.when(value.isNull(), "missing").when(previous.isNull() | (previous == 0), "observed").when(F.abs(change) < threshold, "stable").when(change > 0, "rising").otherwise("falling")


def with_regime(rows: DataFrame, threshold: float = 0.01) -> DataFrame:
    previous = F.lag("value").over(W.partitionBy("factor_id").orderBy("observation_date"))
    return rows.withColumn("previous", previous).withColumn("regime", regime(F.col("value"), F.col("previous"), threshold))


def period_end(cadence: Column, day: Column) -> Column:
    quarter = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.when(cadence == "monthly", F.last_day(day)).when(cadence == "quarterly", quarter).when(cadence == "annual", F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(day)


def available_at(cadence: Column, day: Column, lag_days: Column, released: Column) -> Column:
    """The release time if known, else the period's end and the lag at midnight UTC."""
    return F.coalesce(released, F.date_add(period_end(cadence, day), lag_days).cast("timestamp"))


def theme_context(themes: DataFrame, series: DataFrame, observations: DataFrame, at: Column, most: int = 5) -> DataFrame:
    """Per theme (theme_id, tags) up to ``most`` series (factor_id, tags) that share a tag, with their regime at ``at``."""
    latest = with_regime(as_of(observations, at, per_factor=2))
    latest = latest.withColumn("_k", F.row_number().over(W.partitionBy("factor_id").orderBy(F.desc("observation_date")))).filter("_k = 1").drop("_k")
    pairs = themes.select("theme_id", F.explode("tags").alias("tag")).join(series.select("factor_id", F.explode("tags").alias("tag")), "tag").groupBy("theme_id", "factor_id").agg(F.count("*").alias("shared_tags"))
    ranked = pairs.join(latest, "factor_id").withColumn("rank", F.row_number().over(W.partitionBy("theme_id").orderBy(F.desc("shared_tags"), "factor_id")))
    return ranked.filter(F.col("rank") <= most)


def refreshed(stored: DataFrame, fetched: DataFrame, series: DataFrame) -> DataFrame:
    """Observations (factor_id, observation_date, value, fetched_at) after a refresh: of a known series and with a date, the latest fetch of each day."""
    valid = fetched.filter("observation_date is not null").join(series.select("factor_id").distinct(), "factor_id", "left_semi")
    rows = stored.unionByName(valid.select(stored.columns))
    return rows.groupBy("factor_id", "observation_date").agg(F.max_by(F.struct("value", "fetched_at"), F.struct("fetched_at", "value")).alias("_o")).select("factor_id", "observation_date", "_o.value", "_o.fetched_at")
