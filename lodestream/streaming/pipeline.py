"""Structured Streaming: buckets, sessions, de-duplication, and a stateful signal gate.

Batch and stream share the operators; a stream only adds a watermark.  ``finished``
runs a stream over what is there (availableNow) into Parquet and reads it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import narrative as N
from ..sources.scratch import shared_dir

# Fixed values
COOLDOWN_MINUTES, ESCALATION = 30.0, 0.25


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table or folder as a stream, with the schema that its files have."""
    schema = spark.read.parquet(path).schema
    if path.rstrip("/").endswith(".parquet") and not _is_folder(spark, path):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result over what is there now."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[str] = []
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out-{epoch}")
        last[:] = [f"{at}/out-{epoch}"]

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(*last) if last else spark.createDataFrame([], df.schema)


def bucket_stream(docs: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Narrative buckets of a stream of documents with ``ts``."""
    return N.buckets(docs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), key)


def session_stream(docs: DataFrame, key: str, gap: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    rows = docs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("doc_count")).select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "doc_count")


def first_seen(docs: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen within the watermark's delay."""
    return docs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


GATED = "key string, ts timestamp, score double, published boolean, reason string"


def _gate(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # after a cooldown every signal is published, as without a state
        state.remove()
        return
    last_at, last_score = state.get if state.exists else (None, 0.0)
    rows = pd.concat([*frames]).sort_values(["ts", "score"], kind="stable")  # a key's rows of one batch may come in several frames
    told = []
    for now, score, triggered in zip(rows["ts"].map(pd.Timestamp.timestamp).tolist(), rows["score"].tolist(), rows["triggered"].tolist(), strict=True):
        quiet = last_at is None or now - last_at >= COOLDOWN_MINUTES * 60
        if triggered and (quiet or score >= last_score + ESCALATION):
            last_at, last_score = now, score
            told.append("quiet" if quiet else "escalated")
        else:
            told.append("cooling" if triggered else "not triggered")
    if last_at is not None:
        state.update((last_at, last_score))
        state.setTimeoutTimestamp(max(int((last_at + COOLDOWN_MINUTES * 60) * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"key": key[0], "ts": rows["ts"].values, "score": rows["score"].values, "published": [x in ("quiet", "escalated") for x in told], "reason": told})


def gated(signals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Signals (key, ts, score, triggered) with whether each is published: when the last was published a cooldown of 30 minutes ago or never, or the score rose by .25.

    The state of a key is one time and one score, and leaves with the cooldown; a task
    holds what one batch has of a key, in the order of time and score.
    """
    rows = signals.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(_gate, GATED, "last_at double, last_score double", "append", GroupStateTimeout.EventTimeTimeout)
