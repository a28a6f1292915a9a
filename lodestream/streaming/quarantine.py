"""A sink with a quarantine: rows that fail are tried again in the next batches, and put aside after the last try.

For each batch the sink writes three folders, ``good``, ``retry`` and ``dead``, named by the batch.
What a batch writes follows from its rows and the ``retry`` folder of the batch before alone, and it
replaces its own folders, so a batch that is replayed, even after half a write, leaves each row once.  A batch's rows are
judged once, into a table in the shared folder; nothing is kept in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import discard, table

# Fixed value: tries of a row
TRIES = 3
KINDS = ("good", "retry", "dead")


@dataclass(frozen=True)
class Quarantine:
    """judge: adds the column ``error`` to rows, null for good ones; its other columns are what is written."""

    path: str
    judge: Callable[[DataFrame], DataFrame]
    tries: int = TRIES

    def _folder(self, kind: str, epoch: int) -> str:
        return f"{self.path}/{kind}/epoch={epoch}"

    def waiting(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """Rows that failed in a batch and will be tried again, with the tries they had."""
        try:
            return spark.read.parquet(self._folder("retry", epoch))
        except AnalysisException:  # no such batch
            return None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch."""
        rows = batch.withColumn("tries", F.lit(0))
        before = self.waiting(batch.sparkSession, epoch - 1)
        if before is not None:
            rows = rows.unionByName(before.select(*batch.columns, "tries"))
        judged = self.judge(rows).withColumn("tries", F.col("tries") + 1)
        columns = [c for c in judged.columns if c not in (*batch.columns, "tries", "error")]
        judged = table(judged)
        failed = judged.filter("error is not null").select(*batch.columns, "error", "tries")
        parts = {"good": judged.filter("error is null").select(*batch.columns, *columns, "tries"), "retry": failed.filter(F.col("tries") < self.tries), "dead": failed.filter(F.col("tries") >= self.tries)}
        for kind in KINDS:
            parts[kind].write.mode("overwrite").parquet(self._folder(kind, epoch))
        discard(judged)

    def drain(self, spark: SparkSession, epoch: int) -> int:
        """Batches without new rows until none waits; the number of the last one."""
        while (left := self.waiting(spark, epoch)) is not None and left.limit(1).count():
            epoch += 1
            self(left.drop("error", "tries").limit(0), epoch)
        return epoch

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """All rows of a kind and their batch."""
        return spark.read.parquet(f"{self.path}/{kind}")
