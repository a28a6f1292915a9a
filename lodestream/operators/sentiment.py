"""Sentiment of themes and entities from labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .themes import days_between

# Fixed values
DECAY, AUTHORITY_BOOST, CONFIDENCE_BOOST, WINDOW_DAYS = 0.3, 0.3, 0.2, 7
BULLISH, BEARISH = 0.85, 0.15


def document_weight(age_days: Column, authority: Column, confidence: Column) -> Column:
    return F.exp(F.lit(-DECAY) * F.greatest(age_days, F.lit(0.0))) * (1 + AUTHORITY_BOOST * F.coalesce(authority, F.lit(0.0))) * (1 + CONFIDENCE_BOOST * confidence)


def theme_sentiment(docs: DataFrame, at: Column, key: str = "theme_id") -> DataFrame:
    """Weighted label shares, confidence, authority and daily slope by key over the WINDOW_DAYS days that end at ``at``."""
    age = days_between(at, F.col("ts"))
    rows = docs.filter((age >= 0) & (age <= WINDOW_DAYS)).withColumn("w", document_weight(age, F.col("authority"), F.col("confidence"))).withColumn("day", F.to_date("ts"))
    total = F.sum("w")
    share = lambda label: (F.sum(F.when(F.col("label") == label, F.col("w")).otherwise(0.0)) / total)
    main = rows.groupBy(key).agg(share("positive").alias("bullish_ratio"), share("negative").alias("bearish_ratio"), share("neutral").alias("neutral_ratio"), (F.sum(F.col("w") * F.col("confidence")) / total).alias("avg_confidence"), F.avg("authority").alias("avg_authority"), F.count("*").alias("document_count"))
    daily = rows.groupBy(key, "day").agg(F.avg(F.when(F.col("label") == "positive", 1.0).otherwise(0.0)).alias("y"))
    slope = daily.withColumn("x", F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double")).groupBy(key).agg(F.when(F.count("*") >= 2, F.regr_slope("y", "x")).alias("sentiment_velocity"))
    extreme = F.when(F.col("bullish_ratio") >= BULLISH, "extreme_bullish").when(F.col("bullish_ratio") <= BEARISH, "extreme_bearish")
    return main.join(slope, key).withColumn("extreme", extreme)


def attributed(docs: DataFrame, at: Column, limit: int, key: str = "theme_id") -> DataFrame:
    """Each document's share of its theme's weighted sentiment; the ``limit`` largest by size."""
    age = days_between(at, F.col("ts"))
    sign = F.when(F.col("label") == "positive", 1.0).when(F.col("label") == "negative", -1.0).otherwise(0.0)
    rows = docs.withColumn("w", document_weight(age, F.col("authority"), F.col("confidence"))).withColumn("share", sign * F.col("w") / F.sum("w").over(W.partitionBy(key)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("share")), "doc_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
