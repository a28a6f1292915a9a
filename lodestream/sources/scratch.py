"""Intermediate tables in the shared folder, which survive the loss of any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
PART_BYTES = 16 << 20
#: Where Spark doesn't know a size it says a very large one.
UNKNOWN_BYTES = 1 << 50
#: Spark's own setting: a finished query's shuffle files are deleted with it.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names.  Where the setting is unset, local mode (tests) gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestream-"))
        found = f"file://{_own[0]}"
    return f"{found.rstrip('/')}/lodestream-{spark.sparkContext.applicationId}"


def parts(df: DataFrame, part: int = PART_BYTES) -> int:
    """The session's shuffle partitions, and one at least for each part (bytes) of the files and rows that df reads: a task's share stays the same at any scale."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < UNKNOWN_BYTES)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // part))


def table(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, lineage cut.

    What the computation shuffled is deleted with its end, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``table`` returned and nobody reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if f"/lodestream-{t.sparkSession.sparkContext.applicationId}/" in f"{folder}/":
                _delete(t.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables."""
    _delete(spark, shared_dir(spark))
