"""Packing into optimal length buckets.

The lengths of all documents form one histogram; dynamic programming over it
chooses the ``buckets`` upper bounds for which padding every document to its
bucket's bound wastes the fewest tokens.  Every bucket's documents are then dealt
into batches of ``budget`` padded tokens at most (a document longer than the
budget is a batch of its own).

The histogram has a row for each distinct length, summed before the shuffle; the
programme's layers are divided and conquered, so it takes
O(buckets * lengths * log lengths) steps on the driver.  A document's number in its
bucket is a two-level prefix sum over hash cells: no task holds a bucket.

Null or empty text: length 0, in the first bucket, padded to its bound.  Repeated
rows are packed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .storage import table
from .textops import Words, slices

BUCKETS, BUDGET, CELLS = 16, 16_384, 256


def word_lengths(batches):
    for rows, data, off in slices(batches):
        yield pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(Words(data, off, hashed=False).counts, pa.int64())], names=["kept_columns", "n_tokens"])


def token_lengths(path: str):
    """Lengths in tokens of a tokenizer file of the library tokenizers."""

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = [len(x.ids) for at in range(0, len(texts), 64) for x in t.encode_batch(texts[at : at + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("kept_columns"), pa.array(n, pa.int64())], names=["kept_columns", "n_tokens"])

    return run


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the sorted distinct lengths with the least total padding."""
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    best = np.where(np.arange(m + 1) == 0, 0, np.iinfo(np.int64).max // 4)
    chosen = []
    for _ in range(buckets):
        new, cut = np.full(m + 1, np.iinfo(np.int64).max // 4), np.zeros(m + 1, np.int64)
        new[0] = 0
        spans = np.array([[1, m, 0, m - 1]])  # ends j from a to b, whose best starts lie from c to d
        while len(spans):
            mid = (spans[:, 0] + spans[:, 1]) // 2
            low, high = spans[:, 2], np.minimum(spans[:, 3], mid - 1)
            width = high - low + 1
            at = np.concatenate(([0], np.cumsum(width)))
            start = np.arange(at[-1]) - np.repeat(at[:-1], width) + np.repeat(low, width)
            end = np.repeat(mid, width)
            cost = best[start] + lengths[end - 1] * (total[end] - total[start])  # the sum of lengths is the same for all
            least = np.minimum.reduceat(cost, at[:-1])
            first = np.flatnonzero(cost == np.repeat(least, width))
            group = np.repeat(np.arange(len(mid)), width)[first]
            pick = first[np.unique(group, return_index=True)[1]]
            new[mid], cut[mid] = least, start[pick]
            left = np.stack([spans[:, 0], mid - 1, spans[:, 2], cut[mid]], axis=1)
            right = np.stack([mid + 1, spans[:, 1], cut[mid], spans[:, 3]], axis=1)
            spans = np.concatenate([left, right])
            spans = spans[spans[:, 0] <= spans[:, 1]]
        best = new
        chosen.append(cut)
    bounds, j = [], m
    for cut in reversed(chosen):
        if j <= 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, keep: list[str], id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, lengths=word_lengths) -> DataFrame:
    """The columns keep of docs (but for clashing names), n_tokens, bucket, padded_length, batch and slot (place in the batch).

    Batches are numbered inside their bucket.
    """
    keep = [c for c in dict.fromkeys([*keep, id_col]) if c not in ("n_tokens", "bucket", "padded_length", "batch", "slot")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text")
    sized = base.mapInArrow(lengths, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, n_tokens long")
    sized = table(sized.withColumns({"uid": F.monotonically_increasing_id(), "cell": F.pmod(F.xxhash64(f"kept_columns.{id_col}"), F.lit(CELLS)).cast("int")}))
    histogram = sorted((r[0], r[1]) for r in sized.groupBy("n_tokens").count().collect())  # a row for each distinct length
    bounds = optimal_bounds(np.array([x for x, _ in histogram], np.int64), np.array([x for _, x in histogram], np.int64), buckets)
    bucket, bound = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for k, b in list(enumerate(bounds))[1:]:
        above = F.col("n_tokens") > bounds[k - 1]
        bucket, bound = F.when(above, k).otherwise(bucket), F.when(above, F.lit(b).cast("long")).otherwise(bound)
    placed = sized.withColumns({"bucket": bucket.cast("int"), "padded_length": bound})
    before = W.partitionBy("bucket").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = placed.groupBy("bucket", "cell").count().select("bucket", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    number = F.row_number().over(W.partitionBy("bucket", "cell").orderBy(f"kept_columns.{id_col}", "uid")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), "padded_length"))).cast("long")
    out = placed.withColumn("number", number).join(F.broadcast(cells), ["bucket", "cell"]).withColumn("number", F.col("number") + F.col("ahead"))
    return out.select(*[F.col(f"kept_columns.`{c}`") for c in keep], "n_tokens", "bucket", "padded_length", F.floor(F.col("number") / room).cast("long").alias("batch"), F.pmod("number", room).cast("int").alias("slot"))


def op6_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch, slot of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
