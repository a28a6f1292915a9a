"""An inverted file of vectors: coarse cells as partitions of a table, of which a search reads only those it needs.

Coarse centroids are fitted on a bounded sample (``SAMPLE`` rows, those of the least
hash of id); every row is then indexed under its nearest centroid.  A cell also keeps the
widest angle between its centroid and a member, so cells that can't hold a vector as similar
as the threshold are left out without loss; ``probes`` limits a search to so many nearest
cells a query, which is faster and approximate.

Vectors are compared by cosine.  Rows whose vector is null, empty, all zeros, or has null or
non-finite components are not indexed and queries of that kind find nothing; vectors of other dimensions than the first
centroid's are errors of the caller.  Repeated ids are rows of their own; without an id a row isn't found and a query finds nothing,
as nobody can tell whether it is the other.  An empty table gives an index
without cells.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import shared_dir
from .vectors import MOST_CENTROIDS, MOST_QUERIES, matrix, unit

#: Rows that centroids are fitted on, rounds of the fit, rows that a cell should hold, and files its rows are spread over.
SAMPLE, FIT_ROUNDS, PER_CELL, SPREAD = 20_000, 8, 4096, 4
#: Rounding of angles, in radians.
MARGIN = 1e-6


def usable(vector: str) -> Column:
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def fit(rows: DataFrame, id_col: str, vector: str, cells: int | None = None, per_cell: int = PER_CELL) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells (one for each per_cell rows if not given, MOST_CENTROIDS at most) from the bounded sample."""
    cells = cells or min(MOST_CENTROIDS, max(1, rows.count() // per_cell))
    seen = rows.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector).collect()
    if not seen:
        return np.zeros((0, 0))
    x = unit(np.array([r[0] for r in seen], float))
    c = x[: min(cells, len(x))].copy()
    for _ in range(FIT_ROUNDS):
        own = np.concatenate([(x[at : at + 1024] @ c.T).argmax(axis=1) for at in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.linalg.norm(sums, axis=1) > 0
        c[held] = unit(sums[held])
    return c


def first(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, in order; of equal ones the first column is less."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    near = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    tied = (d <= np.take_along_axis(d, near[:, -1:], axis=1)).sum(axis=1) > k
    near[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return near


def celled(rows: DataFrame, centroids: np.ndarray, id_col: str, vector: str, probes: int = 1) -> DataFrame:
    """id, vector, cell (the nearest), angle to its centroid and, for more probes, cells: the nearest ones in order."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    many = probes > 1
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {vector} array<float>, cell int, angle double{', cells array<int>' if many else ''}"

    def run(batches):
        c = sent.value
        k = min(probes, len(c))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = unit(matrix(part.column(vector))) @ c.T
                near = first(-s, k).astype(np.int32) if many else s.argmax(axis=1)[:, None].astype(np.int32)
                angle = np.arccos(np.clip(s[np.arange(len(s)), near[:, 0]], -1, 1))
                columns = [part.column(id_col), part.column(vector).cast(pa.list_(pa.float32())), pa.array(near[:, 0]), pa.array(angle)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(list(near), pa.list_(pa.int32()))] if many else [])], names=[id_col, vector, "cell", "angle", *(["cells"] if many else [])])

    return rows.select(id_col, vector).mapInArrow(run, schema)


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies: ``rows`` (id, vector, partitioned by cell) and ``cells`` (cell, centroid, angle, n)."""

    path: str
    id_col: str
    vector: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def build(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, path: str | None = None) -> VectorIndex:
    """Writes the index of rows to path (a folder of its own below the shared one if not given)."""
    spark = rows.sparkSession
    index = VectorIndex(path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", id_col, vector)
    good = rows.filter(usable(vector)).select(id_col, F.col(vector).cast("array<float>").alias(vector))
    centroids = fit(good, id_col, vector, cells)
    if not len(centroids):
        good.withColumn("cell", F.lit(0)).write.parquet(f"{index.path}/rows")
        spark.createDataFrame([], "cell int, centroid array<double>, angle double, n long").write.parquet(f"{index.path}/cells")
        return index
    placed = celled(good, centroids, id_col, vector)
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).write.partitionBy("cell").parquet(f"{index.path}/rows")
    angles = index.rows(spark).groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
    names = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
    angles.join(F.broadcast(names), "cell").write.parquet(f"{index.path}/cells")
    return index


def wanted(similarity: np.ndarray, angles: np.ndarray, threshold: float, probes: int | None) -> np.ndarray:
    """Which cells (columns) each query (rows) has to read."""
    angle = np.arccos(np.clip(similarity, -1, 1))
    can = angle - angles <= np.arccos(np.clip(threshold, -1, 1)) + MARGIN
    if probes is not None and probes < similarity.shape[1]:
        near = np.argsort(angle, axis=1, kind="stable")[:, :probes]
        mask = np.zeros_like(can)
        np.put_along_axis(mask, near, True, axis=1)
        can &= mask
    return can


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, limit: int, threshold: float, probes: int | None = None) -> DataFrame:
    """(query, id, similarity, rank): the ``limit`` rows most similar to each query (query, vector), at least threshold, itself left out.

    Without probes the result is exact.  Queries that need the same cells are taken together, MOST_QUERIES at
    once; each such block reads the partitions of its own cells only.
    """
    kinds = index.rows(spark).schema
    id_type = kinds[index.id_col].dataType.simpleString()
    found = sorted(((r["cell"], r["centroid"], r["angle"]) for r in index.cells(spark).collect()), key=lambda r: r[0])  # MOST_CENTROIDS at most
    schema = f"query {queries.schema['query'].dataType.simpleString()}, {index.id_col} {id_type}, similarity double"
    good = queries.filter(usable(index.vector)).select("query", F.col(index.vector).cast("array<float>").alias(index.vector))
    out = None
    if found:
        numbers, centroids, angles = np.array([r[0] for r in found]), np.array([r[1] for r in found]), np.array([r[2] for r in found])
        near = celled(good, centroids, "query", index.vector)
        near = near.select("query", index.vector, "cell").orderBy("cell", "query")
        for block in _blocks(near, index.vector):
            names, q = block
            reads = wanted(q @ centroids.T, angles, threshold, probes)
            cells = numbers[reads.any(axis=0)].tolist()
            if not cells:
                continue
            sent = spark.sparkContext.broadcast((names, q, {int(c): np.flatnonzero(reads[:, k]) for k, c in enumerate(numbers)}))
            part = index.rows(spark).filter(F.col("cell").isin(cells)).select(index.id_col, index.vector, "cell").mapInArrow(_best(sent, index, limit, threshold, [to_arrow_type(t) for t in (good.schema["query"].dataType, kinds[index.id_col].dataType)]), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), index.id_col))  # limit rows a task each
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _blocks(rows: DataFrame, vector: str):
    """(keys, unit vectors) of MOST_QUERIES rows each, in their order; the driver holds one block at a time."""
    names, v = [], []
    for r in rows.toLocalIterator():
        names.append(r[0])
        v.append(r[1])
        if len(names) == MOST_QUERIES:
            yield names, unit(np.array(v, float))
            names, v = [], []
    if names:
        yield names, unit(np.array(v, float))


def _best(sent, index: VectorIndex, limit: int, threshold: float, types: list[pa.DataType]):
    """The best rows of each query in a task; a query is compared with the cells that it reads only."""

    def run(batches):
        names, q, readers = sent.value
        held = [[] for _ in names]
        for batch in batches:
            ids, v, cell = batch.column(index.id_col).to_pylist(), unit(matrix(batch.column(index.vector))), batch.column("cell").to_numpy()
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), readers[int(c)]
                s = np.round(q[who] @ v[at].T, 9)
                for i, j in zip(*np.nonzero(s >= threshold), strict=True):
                    if ids[at[j]] is not None and names[who[i]] is not None and ids[at[j]] != names[who[i]]:
                        held[who[i]].append((-s[i, j], ids[at[j]]))
            for i, h in enumerate(held):
                if len(h) > 4 * limit:
                    held[i] = heapq.nsmallest(limit, h)
        for i, h in enumerate(held):
            if h := heapq.nsmallest(limit, h):
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(h), types[0]), pa.array([k for _, k in h], types[1]), pa.array([-s for s, _ in h], pa.float64())], names=["query", index.id_col, "similarity"])

    return run
