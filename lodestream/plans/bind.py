"""How the test tables stand for the engine's inputs, in Spark and, as WITH parts, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed documents with theme, platform, authority, sentiment and entity, from events."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("doc_id"),
        "ts",
        (F.col("user_id") % 10).alias("theme_id"),
        F.when(F.col("event_type") == "click", "twitter").when(F.col("event_type") == "view", "reddit").when(F.col("event_type") == "purchase", "news").when(F.col("event_type") == "error", "substack").otherwise("blog").alias("platform"),
        F.when(v >= 5, F.least(v / 100, F.lit(1.0))).alias("authority"),
        F.when(v >= 50, "positive").when(v < 20, "negative").otherwise("neutral").alias("label"),
        (F.lit(0.5) + (F.col("event_id") % 50) / 100).alias("confidence"),
        F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("entity"),
        (F.col("user_id") % 3 == 0).alias("verified"),
    )


SIGNALS = """signals AS (SELECT event_id AS doc_id, ts, user_id % 10 AS theme_id,
 CASE event_type WHEN 'click' THEN 'twitter' WHEN 'view' THEN 'reddit' WHEN 'purchase' THEN 'news' WHEN 'error' THEN 'substack' ELSE 'blog' END AS platform,
 CASE WHEN value >= 5 THEN least(value / 100, 1.0) END AS authority,
 CASE WHEN value >= 50 THEN 'positive' WHEN value < 20 THEN 'negative' ELSE 'neutral' END AS label,
 0.5 + (event_id % 50) / 100.0 AS confidence, 'k' || regexp_extract(props, '([0-9]+)', 1) AS entity, user_id % 3 = 0 AS verified FROM events)"""
