"""Intermediate tables in the shared folder, and rows that keep their number each time they are read."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import clean, discard, shared_dir, table

__all__ = ["clean", "discard", "input_bytes", "numbered", "shared_dir", "table"]
#: A row's number is its file's, shifted by so many bits, and its place in the file.
ROW_BITS = 36
#: A list of so many paths is small enough to broadcast (about 20 MB).
FILES = 100_000
#: Paths are listed with another number of slashes after the scheme than rows tell them.
SLASHES = r"^([\w.+-]+):/+"


def _plain(node) -> bool:
    """Whether a plan is one relation of files under projections and filters."""
    children = node.children()
    if not children.size():
        return node.nodeName() == "LogicalRelation"
    return node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and children.size() == 1 and _plain(children.apply(0))


def numbered(docs: DataFrame, columns: list[Column | str], name: str = "uid") -> DataFrame:
    """The columns of docs and a number of each row, which is the same whenever and by however many executors it is read.

    For Parquet files under projections and filters it is the place of the file in the
    sorted list of files, and of the row in its file.  Anything else (shuffles, local
    rows, other files, very many files) is written to the shared folder first, with a number.
    """
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().optimizedPlan().deterministic() and _plain(docs._jdf.queryExecution().analyzed()):
        files = sorted(re.sub(SLASHES, r"\1:/", f) for f in docs.inputFiles())
        try:
            placed = docs.select(*columns, F.regexp_replace("_metadata.file_path", SLASHES, "$1:/").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:  # not Parquet
            placed = None
        if placed is not None and len(files) <= FILES:
            numbers = docs.sparkSession.createDataFrame([(f, k << ROW_BITS) for k, f in enumerate(files)], "_file string, _base long")
            # the last value is never taken: it tells Spark that no number is null, so that both readers of an exchange can share it
            known = F.coalesce(F.col("_base") + F.col("_row"), F.raise_error("a file that wasn't in the input's list").cast("long"), F.lit(-1).cast("long"))
            return placed.join(F.broadcast(numbers), "_file", "left").withColumn(name, known).drop("_file", "_row", "_base")
    return table(docs.select(*columns, F.monotonically_increasing_id().alias(name)))


def input_bytes(docs: DataFrame) -> int:
    """The size of the files that docs reads; 0 where it isn't files under projections and filters, whose estimates mean little."""
    plan = docs._jdf.queryExecution()
    return int(str(plan.analyzed().stats().sizeInBytes())) if _plain(plan.analyzed()) else 0
