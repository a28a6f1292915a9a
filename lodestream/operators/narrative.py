"""Narrative runs: five-minute buckets and the signals read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values
BUCKET = "5 minutes"
SURGE_DOCS, SURGE_RATE, SURGE_Z, SURGE_UPLIFT = 8, 6.0, 3.0, 2.5
BREAKOUT_HOURS, AUTHORITY_GAP, SHIFT, SHIFT_CONFIDENCE, SHIFT_DOCS, SIDE_DOCS = 6.0, 0.45, 0.35, 0.70, 6, 3


def sign_of(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def buckets(docs: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Sums by key and five-minute bucket; docs may be a stream with a watermark on ``time``."""
    high = F.coalesce(F.col("authority"), F.lit(0.0)) >= 0.5
    s = sign_of(F.col("label"))
    out = docs.groupBy(key, F.window(time, BUCKET).alias("w")).agg(
        F.count("*").alias("doc_count"),
        F.sum(s * F.col("confidence")).alias("sentiment_sum"),
        F.sum("confidence").alias("sentiment_weight"),
        F.sum(F.when(high, s * F.col("confidence")).otherwise(0.0)).alias("high_authority_sentiment_sum"),
        F.sum(F.when(high, F.col("confidence")).otherwise(0.0)).alias("high_authority_weight"),
        F.count(F.when(high, 1)).alias("high_authority_doc_count"),
    )
    return out.withColumn("bucket_start", F.col("w.start")).drop("w")


def surges(bucketed: DataFrame, at: Column, key: str) -> DataFrame:
    """Rate of the last 30 minutes against the buckets of the 6 hours before; empty buckets don't count.

    A surge needs ``SURGE_DOCS`` documents in all buckets of the key, not only in the recent ones.
    """
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("bucket_start").cast("timestamp"))) / F.lit(60_000_000.0)
    recent, past = (age >= 0) & (age <= 30), (age > 30) & (age <= 360)
    rate = F.col("doc_count") * 12.0
    rows = bucketed.groupBy(key).agg(F.sum("doc_count").alias("total_docs"), F.sum(F.when(recent, F.col("doc_count")).otherwise(0)).alias("recent_docs"), F.coalesce(F.avg(F.when(past, rate)), F.lit(0.0)).alias("base_rate"), F.stddev_pop(F.when(past, rate)).alias("base_spread"), F.count(F.when(past, 1)).alias("base_buckets"))
    rows = rows.withColumn("rate_per_hour", F.col("recent_docs") * 2.0)
    z = F.when((F.col("base_buckets") > 1) & (F.col("base_spread") > 1e-9), (F.col("rate_per_hour") - F.col("base_rate")) / F.col("base_spread")).otherwise(0.0)
    uplift = F.when(F.col("base_rate") > 0, F.col("rate_per_hour") / F.col("base_rate")).otherwise(0.0)
    rows = rows.withColumns({"z": z, "uplift": uplift})
    return rows.withColumn("triggered", (F.col("total_docs") >= SURGE_DOCS) & (F.col("rate_per_hour") >= SURGE_RATE) & ((F.col("z") >= SURGE_Z) | (F.col("uplift") >= SURGE_UPLIFT)))


def breakouts(docs: DataFrame, key: str) -> DataFrame:
    """Hours from a run's first platform to its third, and whether they are few enough."""
    first = docs.groupBy(key, "platform").agg(F.min("ts").alias("seen")).groupBy(key).agg(F.array_sort(F.collect_list("seen")).alias("seen"))
    hours = (F.unix_micros(F.get("seen", F.lit(2)).cast("timestamp")) - F.unix_micros(F.get("seen", F.lit(0)).cast("timestamp"))) / F.lit(3_600_000_000.0)
    return first.select(key, F.size("seen").cast("long").alias("platforms"), hours.alias("hours")).withColumn("triggered", F.coalesce(F.col("hours") <= BREAKOUT_HOURS, F.lit(False)))


def authority_divergence(docs: DataFrame, key: str) -> DataFrame:
    """Gap of mean sentiment between high- and low-authority documents."""
    high = F.coalesce(F.col("authority"), F.lit(0.0)) >= 0.5
    s, c = sign_of(F.col("label")), F.col("confidence")
    mean = lambda side: F.sum(F.when(side, s * c)) / F.sum(F.when(side, c))
    rows = docs.groupBy(key).agg(mean(high).alias("high_sentiment"), mean(~high).alias("low_sentiment"), F.count(F.when(high, 1)).alias("high_docs"), F.count(F.when(~high, 1)).alias("low_docs"))
    enough = (F.col("high_docs") >= SIDE_DOCS) & (F.col("low_docs") >= SIDE_DOCS)
    return rows.withColumn("gap", F.abs(F.col("high_sentiment") - F.col("low_sentiment"))).withColumn("triggered", F.coalesce(enough & (F.col("gap") >= AUTHORITY_GAP), F.lit(False)))


def regime_shifts(docs: DataFrame, at: Column, key: str, hours: float = 12.0) -> DataFrame:
    """Sign change of mean sentiment between the last ``hours`` and as many before."""
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3_600_000_000.0)
    new, old = (age >= 0) & (age < hours), (age >= hours) & (age < 2 * hours)
    s, c = sign_of(F.col("label")), F.col("confidence")
    mean = lambda side: F.sum(F.when(side, s * c)) / F.sum(F.when(side, c))
    rows = docs.groupBy(key).agg(F.count(F.when(new, 1)).alias("recent_docs"), F.count(F.when(old, 1)).alias("prior_docs"), mean(new).alias("recent"), mean(old).alias("prior"), F.avg(F.when(new, c)).alias("recent_confidence"))
    crossed = ((F.col("prior") < 0) & (F.col("recent") >= 0)) | ((F.col("prior") > 0) & (F.col("recent") <= 0))
    ok = (F.col("recent_docs") >= SHIFT_DOCS) & (F.col("prior_docs") >= SHIFT_DOCS) & crossed & (F.abs(F.col("recent") - F.col("prior")) >= SHIFT) & (F.col("recent_confidence") >= SHIFT_CONFIDENCE)
    return rows.withColumn("triggered", F.coalesce(ok, F.lit(False)))


def sessions(docs: DataFrame, key: str, gap_hours: float) -> DataFrame:
    """Runs of a key's documents with no pause of gap_hours or more: start, end, documents."""
    by = W.partitionBy(key).orderBy("ts", "doc_id")
    pause = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))) / F.lit(3_600_000_000.0)
    new = F.when(pause.isNull() | (pause >= gap_hours), 1).otherwise(0)
    return docs.withColumn("_new", new).withColumn("run", F.sum("_new").over(by)).groupBy(key, "run").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_document_at"), F.count("*").alias("doc_count"))
