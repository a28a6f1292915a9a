"""How the filters of a cleaning run work together, whatever their order.

Arrow buffers are scanned in bounded slices: a table of byte classes, summed up along
the bytes, gives code points, capitals and symbols of any stretch as a difference of two
prefix sums; each document's words are sorted by hash, neighbours of one hash are compared
byte by byte, and what differs is distinct.  The verdicts are one bit mask a document.
All that any order of the filters does is a function of how many documents have which
mask, so masks are counted by part in Spark (with map-side sums) and every order is
a product of those counts, at most 2^filters a part, with a fixed 0/1 matrix.

The filter for copies needs the whole table: the least id of each text (by its SHA-256)
is found by one aggregate and joined on id and text, so a group of copies of any size
never meets in one task.

A null text counts as an empty one, a null part as the empty string.  A row without an id is
smaller than no other and no other is smaller than it, so it is never a copy nor makes one.
Repeated rows (id and text) are judged alike.  A document is good, or toxic, if a
label of its id says so.  An empty table has no parts, hence no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import table
from .textops import Words, slices

#: Bytes whose classes are summed at once; three counts of so many fit into one 64-bit number.
STRETCH, FIELD = 1 << 20, 21
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


@dataclass(frozen=True)
class Limits:
    """Failing: A fewer words; B fewer distinct words in a hundred words; C more capitals in a hundred code points; D any of the symbols."""

    words: int = 50
    distinct: int = 65
    capitals: int = 5
    symbols: bytes = b"#$%&*|"


def byte_classes(symbols: bytes) -> np.ndarray:
    """For each byte one number with three fields: first byte of a code point, capital, symbol."""
    weight = np.zeros(256, np.int64)
    weight[:0x80] = weight[0xC0:] = 1
    weight[0x41:0x5B] += 1 << FIELD
    weight[list(symbols)] += 1 << 2 * FIELD
    return weight


def class_counts(data: np.ndarray, off: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Code points, capitals and symbols of each row."""
    out, mask = [np.zeros(len(off) - 1, np.int64) for _ in range(3)], (1 << FIELD) - 1
    for at in range(0, len(data), STRETCH):
        prefix = np.concatenate(([0], np.cumsum(weight[data[at : at + STRETCH]])))
        edge = np.clip(off, at, at + len(prefix) - 1) - at
        found = prefix[edge[1:]] - prefix[edge[:-1]]
        for k in range(3):
            out[k] += (found >> k * FIELD) & mask
    return out


def masks(data: np.ndarray, off: np.ndarray, limits: Limits, weight: np.ndarray) -> np.ndarray:
    """Bit k is set where a row fails the k-th of the filters A to D."""
    words = Words(data, off)
    order, new = words.kinds(by_row=True)
    distinct = np.bincount(words.row[order[new]], minlength=len(off) - 1)
    points, capitals, symbols = class_counts(data, off, weight)
    fails = [words.counts < limits.words, 100 * distinct < limits.distinct * words.counts, 100 * capitals > limits.capitals * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """id, part, digest (SHA-256 of the text) and mask (bits of A to D) of every row; other columns of docs, whatever their names, are left out."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    weight = byte_classes(limits.symbols)

    def run(batches):
        for rows, data, off in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("part"), rows.column("digest"), pa.array(masks(data, off, limits, weight), pa.int32())], names=["id", "part", "digest", "mask"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: how many documents have each mask."""
    rows = table(failures(docs, id_col, part_col, limits))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("earliest", F.lit(1))
    judged = rows.filter("id is not null").join(first, ["id", "digest"], "left").withColumn("mask", F.when(F.col("earliest").isNull(), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    judged = judged.join(known, "id", "left").select("part", "mask", "good", "toxic").unionByName(rows.filter("id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))
    return judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def effects(filters: str) -> dict[str, np.ndarray]:
    """For every order and step in turn, whether a mask counts as kept, removed, redundant and unique; and each step's filter."""
    m = np.arange(1 << len(filters))
    out = {k: [] for k in ("kept", "removed", "redundant", "unique", "filter")}
    for order in permutations(range(len(filters))):
        before = 0
        for f in order:
            fails, gone = m >> f & 1 == 1, m & before != 0
            before |= 1 << f
            for k, x in (("kept", m & before == 0), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique", m == 1 << f), ("filter", f)):
                out[k].append(x)
    return {k: np.array(v).astype(np.int64) for k, v in out.items()}


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of every order of the filters, from part, mask, n, good, toxic."""
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        e = effects(filters)
        orders = ["".join(o) for o in permutations(filters) for _ in o]
        steps = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders) // len(filters))
        for batch in batches:
            for part, masks_of in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 1 << len(filters)), np.int64)
                for x in masks_of:  # at most 2^filters
                    n[x["mask"]], good[x["mask"]], toxic[x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = e["removed"] @ n
                total = np.zeros(len(filters), np.int64)
                np.add.at(total, e["filter"], removed)
                columns = [e["kept"] @ n, removed, e["redundant"] @ n, e["unique"] @ n, e["removed"] @ good, e["removed"] @ toxic, total[e["filter"]]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), pa.array(orders), pa.array(steps), *map(pa.array, columns)], names=names)

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """What each filter keeps, removes, repeats and loses at each step of each order, by part."""
    return interactions(mask_counts(docs, labels, id_col, part_col, limits))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each source, order and step."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS f, o[1 : step - 1] AS before FROM o, range(1, 6) r(step)),
t AS (SELECT part, o, step, f, n, good, toxic, fails[f] AS hit, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS lone FROM s, c),
g AS (SELECT part, o, step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND lone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM t GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
