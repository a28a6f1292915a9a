"""A positional inverted file of texts, searched by cover density and by BM25 without reading the texts.

A posting list has a term's occurrences in a stretch of the input, so what is shuffled and stored are a
few bytes a word.  Lists are a
Parquet table partitioned by a hash of the term and sorted by term, so a search reads
the partitions of its terms and, by statistics, few row groups of them; a frequent term's lists
are spread over ``SPREAD`` files.  Rows are told apart by a number of their own, so null and repeated
ids are rows like others.

Cover density: a cover is a stretch of a text that holds every term of the query and no
shorter one inside; each counts ``WEIGHT`` / (1 + words in it that are no terms), and a
row's rank is the sum.  A null text and one without words has no postings; an empty query finds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.scratch import FREED, shared_dir
from .keywords import token_slices

BUCKETS, SPREAD, WEIGHT = 64, 4, 0.1
#: The partition of the rows' own records; words of a stretch, whose occurrences of a term are one list.
ROWS, STRETCH = -1, 1_000_000


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies: a table partitioned by bucket.

    A posting list (term, base, rows, places) has a term's occurrences in a stretch of the input: rows counted from base, and places.
    Partition ROWS has each row's number (base), id and length.
    """

    path: str
    id_col: str
    id_type: str
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"term string, base long, rows array<int>, places array<int>, {self.id_col} {self.id_type}, length long, bucket int").parquet(self.path)

    def occurrences(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """row, term, place of the terms, from the partitions they hash to."""
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()
        lists = self.read(spark).filter(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms))
        each = F.inline(F.arrays_zip("rows", "places"))
        return lists.select("term", "base", each).select((F.col("base") + F.col("rows")).alias("row"), "term", F.col("places").alias("place"))

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).filter(F.col("bucket") == ROWS).select(F.col("base").alias("row"), self.id_col, "length")


def build(docs: DataFrame, text: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, path: str | None = None) -> TextIndex:
    """Writes the index of docs to path (a folder of its own below the shared one if not given), in one pass over the texts."""
    spark = docs.sparkSession
    index = TextIndex(path or f"{shared_dir(spark)}/text-{uuid.uuid4().hex}", id_col, docs.schema[id_col].dataType.simpleString(), buckets)
    names = ["term", "base", "rows", "places", id_col, "length"]

    def run(batches):
        for rows, row, code, spelled in token_slices(batches, size=STRETCH):
            number, ids = rows.column("row").to_numpy(), rows.column(id_col)
            order = np.lexsort((row, code))  # stable: places stay in order
            head = np.flatnonzero(np.diff(code[order], prepend=-1))
            off = pa.array(np.append(head, len(order)).astype(np.int32))
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            lists = [spelled.take(pa.array(code[order][head])), pa.array(np.full(len(head), number[0])), pa.ListArray.from_arrays(off, pa.array((number[row[order]] - number[0]).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(place[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*lists, pa.nulls(len(head), ids.type), pa.nulls(len(head), pa.int64())], names=names)
            n, none = rows.num_rows, pa.nulls(rows.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, spelled.type), pa.array(number), none, none, ids, pa.array(np.bincount(row, minlength=n).astype(np.int64))], names=names)

    words = docs.select(F.monotonically_increasing_id().alias("row"), id_col, T.words(F.coalesce(text, F.lit(""))).alias("tokens"))
    found = words.mapInArrow(run, f"term string, base long, rows array<int>, places array<int>, {id_col} {index.id_type}, length long")
    found = found.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("term"), F.lit(buckets)), F.lit(ROWS)).cast("int")).withColumn("bucket", F.when(F.col("term").isNull(), ROWS).otherwise(F.col("bucket")))
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        found.repartition(F.col("bucket"), F.pmod(F.xxhash64("base"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "base").write.partitionBy("bucket").parquet(index.path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return index


def cover_search(spark: SparkSession, index: TextIndex, terms: list[str], limit: int, weight: float = WEIGHT) -> DataFrame:
    """id, rank of the ``limit`` rows with every term, by cover density, then id."""
    terms = sorted({t.lower() for t in terms if t})
    schema = f"{index.id_col} {index.id_type}, rank double"
    if not terms:
        return spark.createDataFrame([], schema)

    def ranks(batches):
        for b in batches:
            lists = b.column("entries")
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            entries = lists.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            place, term = entries.field("place").to_numpy(), entries.field("number").to_numpy()
            order = np.lexsort((place, doc))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(weight * covers(doc[order], place[order], term[order], len(terms), b.num_rows))], names=["row", "rank"])

    number = reduce(lambda out, t: F.when(F.col("term") == t[1], t[0]).otherwise(out), enumerate(terms), F.lit(-1))
    met = index.occurrences(spark, terms).withColumn("number", number)
    rows = met.groupBy("row").agg(F.collect_list(F.struct("place", "number")).alias("entries"), F.countDistinct("number").alias("n"))  # occurrences in one text
    ranked = rows.filter(F.col("n") == len(terms)).select("row", "entries").mapInArrow(ranks, "row long, rank double")
    named = ranked.join(index.rows(spark), "row").select(index.id_col, "rank")
    return named.orderBy(F.desc(F.round("rank", 9)), index.id_col).limit(limit)


def covers(doc: np.ndarray, place: np.ndarray, term: np.ndarray, n_terms: int, n_docs: int) -> np.ndarray:
    """Of each document, the sum over its covers of 1 / (1 + words that are no terms); entries lie in order of document and place."""
    k = np.arange(len(doc))
    first = np.searchsorted(doc, doc, side="left")
    begin = k.copy()
    for t in range(n_terms):  # the last entry of each term up to here
        begin = np.minimum(begin, np.maximum.accumulate(np.where(term == t, k, -1)))
    whole = begin >= first
    # of the stretches that begin at the same entry the first one to end is a cover
    end = np.flatnonzero(whole)
    if len(end):
        end = end[np.concatenate(([True], begin[end][1:] != begin[end][:-1]))]
    s = begin[end]
    noise = (place[end] - place[s]) - (end - s)
    return np.bincount(doc[end], 1 / (1 + noise), minlength=n_docs)


def bm25(spark: SparkSession, index: TextIndex, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the rows with any of the terms, from posting lists and lengths alone."""
    terms = sorted({t.lower() for t in terms if t})
    if not terms:
        return spark.createDataFrame([], f"{index.id_col} {index.id_type}, score double")
    hits = index.occurrences(spark, terms).groupBy("row", "term").agg(F.count("*").alias("tf"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term
    totals = index.rows(spark).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    scored = hits.join(index.rows(spark), "row").join(F.broadcast(frequency), "term").crossJoin(F.broadcast(totals))  # one row
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return scored.groupBy("row", index.id_col).agg(F.sum(part).alias("score")).drop("row")
