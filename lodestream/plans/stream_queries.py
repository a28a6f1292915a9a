"""Streaming queries, run over the whole table and read back as batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from ..streaming import pipeline as P, runs as R
from ..streaming.quarantine import Quarantine
from . import bind
from .registry import query
from .theme_queries import NARRATIVE_BUCKETS_SQL, bucket_result


def _events(spark, d):
    """bind.signals over events as a stream."""
    path = f"{d}/events.parquet"

    class Reader:
        read = type("R", (), {"parquet": staticmethod(lambda _: P.stream(spark, path))})

    return bind.signals(Reader, d)


@query(NARRATIVE_BUCKETS_SQL)
def narrative_buckets_stream(spark, d):
    return bucket_result(P.finished(P.bucket_stream(_events(spark, d), "theme_id"), "complete"))


@query(f"WITH {bind.SIGNALS} SELECT theme_id, label, count(*) > 0 AS seen FROM signals GROUP BY 1, 2")
def stream_dedupe(spark, d):
    out = P.finished(P.first_seen(_events(spark, d), ["theme_id", "label"], "40 days"))
    return out.groupBy("theme_id", "label").agg((F.count("*") == 1).alias("seen"))


@query(f"""WITH {bind.SIGNALS}, n AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 24 HOUR, TRUE) THEN 1 ELSE 0 END AS new FROM signals WINDOW w AS (PARTITION BY entity ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts) AS run FROM n)
SELECT entity, min(ts) AS started_at, count(*) AS doc_count FROM s GROUP BY entity, run""")
def session_stream(spark, d):
    out = P.finished(P.session_stream(_events(spark, d), "entity"), "complete")
    return out.select("entity", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "doc_count")


@query(f"""WITH RECURSIVE {bind.SIGNALS}, n AS (SELECT entity AS key, ts, coalesce(authority, 0.0)::DOUBLE AS score, label = 'positive' AS trig, row_number() OVER (PARTITION BY entity ORDER BY ts, coalesce(authority, 0.0)) AS k FROM signals),
g AS (SELECT key, ts, score, k, trig AS published, CASE WHEN trig THEN ts END AS last_at, CASE WHEN trig THEN score ELSE 0.0 END AS last_score FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.ts, n.score, n.k, p, CASE WHEN p THEN n.ts ELSE g_at END, CASE WHEN p THEN n.score ELSE g_score END FROM (SELECT n.*, g.last_at AS g_at, g.last_score AS g_score, n.trig AND (g.last_at IS NULL OR n.ts - g.last_at >= INTERVAL 30 MINUTE OR n.score >= g.last_score + 0.25) AS p FROM n JOIN g ON n.key = g.key AND n.k = g.k + 1) n)
SELECT key, epoch_us(ts) AS at, round(score, 6) AS score, published FROM g""")
def signal_gate_stream(spark, d):
    rows = _events(spark, d).select(F.col("entity").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("authority", F.lit(0.0)).alias("score"), (F.col("label") == "positive").alias("triggered"))
    return P.finished(P.gated(rows)).select("key", F.unix_micros("ts").alias("at"), F.round("score", 6).alias("score"), "published")


@query("SELECT event_id, CASE WHEN value < 5 THEN 'dead' ELSE 'good' END AS kind, CASE WHEN value < 5 THEN 3 WHEN value < 20 THEN 2 ELSE 1 END AS tries, CASE WHEN value < 5 THEN 'too small' END AS error FROM events")
def quarantine_stream(spark, d):
    """Events of a small value fail at every try, those of a middling one at the first."""

    def judge(rows):
        ok = (F.col("value") >= 20) | ((F.col("value") >= 5) & (F.col("tries") >= 1))
        return rows.withColumn("error", F.when(~ok, "too small"))

    at = f"{shared_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    sink = Quarantine(f"{at}/out", judge)
    P.stream(spark, f"{d}/events.parquet").select("event_id", "value").writeStream.foreachBatch(sink.__call__).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink.drain(spark, 0)
    good = sink.read(spark, "good").select("event_id", F.lit("good").alias("kind"), "tries", F.lit(None).cast("string").alias("error"))
    return good.unionByName(sink.read(spark, "dead").select("event_id", F.lit("dead").alias("kind"), "tries", "error"))


@query()
def narrative_runs_stream(spark, d):
    """Vectors as documents of their label's theme, one every ten minutes."""
    rows = P.stream(spark, f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("theme_id"), F.col("vec_id").alias("doc_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 600).alias("at"), "embedding")
    name, store = R.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        return P.finished(R.narrative_runs(rows))
    finally:
        spark.conf.set(name, before)
