"""Clustering around centroids by annulus search.

Components are scaled to whole numbers, so every distance is exact and ties are real.
Centroids are sorted by norm.  A vector x whose distance to some centroid is u has its
nearest centroid c within the annulus |x| - u <= |c| <= |x| + u (triangle inequality);
two binary searches find that range, and only its centroids are compared, exactly,
the smallest number winning ties.  The edges are widened by a rounding margin, so a centroid
on the boundary is compared too.  u is the distance to the centroid of the round before, or
to the one of the nearest norm in the first round.

A round is one scan that writes vectors with their clusters to the shared folder
and one aggregate with map-side sums: a third of all vectors may be equal without any
task getting more than its share.  The driver holds centroids only, of
which there are ``k`` x ``dims`` whatever the data are.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; others have no row.  A
scaled component beyond +-2^27 counts as +-2^27, so that a squared distance fits into
64 bits; sums of distances beyond 64 bits are given as the largest such number.  A null id
counts as the empty text in the seeds' order; repeated ids are vectors of their own, ties
of seeds fall to the smaller vector.  With fewer vectors than k there are as many
centroids.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import discard, table

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Largest scaled component; up to EXACT, products of doubles are exact.
EDGE, EXACT, ROWS = 1 << 27, 1 << 20, 1024
LARGEST = (1 << 63) - 1


def whole(vector: str, dims: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its scaled components."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(EDGE)), F.least(F.lit(float(EDGE)), v.cast("double") * scale))).cast("int"))
    return F.coalesce((F.size(x) == dims) & ~odd, F.lit(False)), scaled


class Annulus:
    """Centroids (rows of whole numbers) in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.lexsort((np.arange(len(squares)), squares))
        self.place = np.argsort(self.number)
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares)

    def ranges(self, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first centroid in each annulus and after its last one."""
        margin = 1e-9 * (norms + bound) + 1e-9
        return np.searchsorted(self.norms, norms - bound - margin, side="left"), np.searchsorted(self.norms, norms + bound + margin, side="right")

    def nearest(self, x: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the centroid nearest to each row of x, and how many distances that took; known: any centroid's number for each row."""
        squares = (x * x).sum(axis=1)
        norms = np.sqrt(squares)
        if known is None:
            right = np.clip(np.searchsorted(self.norms, norms), 1, max(1, len(self.norms) - 1))
            near = np.where(np.abs(self.norms[right - 1] - norms) <= np.abs(self.norms[np.minimum(right, len(self.norms) - 1)] - norms), right - 1, np.minimum(right, len(self.norms) - 1))
        else:
            near = self.place[known]
        bound = np.sqrt(((x - self.centroids[near]) ** 2).sum(axis=1))
        low, high = self.ranges(norms, bound)
        cluster, distance, compared = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(self.centroids).max(initial=0)) <= EXACT else np.int64
        order = np.lexsort((high, low))  # neighbours in it share most of their ranges
        for at in range(0, len(x), ROWS):
            rows = order[at : at + ROWS]
            a, b = low[rows].min(), high[rows].max()
            product = (x[rows].astype(kind) @ self.centroids[a:b].T.astype(kind)).astype(np.int64)
            d = squares[rows, None] - 2 * product + self.squares[a:b]
            inside = (np.arange(a, b) >= low[rows, None]) & (np.arange(a, b) < high[rows, None])
            d[~inside] = LARGEST
            least = d.min(axis=1)
            cluster[rows] = np.where(d == least[:, None], self.number[a:b], len(self.number)).min(axis=1)
            distance[rows] = least
            compared += int(inside.sum())
        return cluster, distance, compared


def _assigned(rows: DataFrame, centroids: np.ndarray, again: bool, with_vectors: bool) -> DataFrame:
    """id, v (if asked for), cluster, distance of each row (id, v and, if again, the cluster of the round before)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    names = ["id", *(["v"] if with_vectors else []), "cluster", "distance"]

    def run(batches):
        annulus = Annulus(sent.value)
        for b in batches:
            if b.num_rows:
                v = b.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                cluster, distance, _ = annulus.nearest(x, b.column("cluster").to_numpy() if again else None)
                yield pa.RecordBatch.from_arrays([b.column("id"), *([v] if with_vectors else []), pa.array(cluster, pa.int32()), pa.array(distance)], names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {'v array<int>, ' if with_vectors else ''}cluster int, distance long")


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids, those with vectors replaced by the floor of their mean."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid at most
        out[r[0]] = [s // r[1] for s in r[2:]]
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid of every kept vector; other columns of rows are left out."""
    kept, scaled = whole(vector, dims, scale)
    base = rows.filter(kept).select(F.col(id_col).alias("id"), scaled.alias("v"))
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = [r[0] for r in base.orderBy(drawn, "v").limit(k).select("v").collect()]  # k rows
    spark = rows.sparkSession
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not seeds:
        return spark.createDataFrame([], schema)
    centroids, now = np.array(seeds, np.int64), base
    for n in range(rounds):
        new = table(_assigned(now, centroids, n > 0, True))
        centroids = _moved(new, centroids)
        if n:
            discard(now)
        now = new
    last = table(_assigned(now, centroids, rounds > 0, False))
    if rounds:
        discard(now)
    found = {r[0]: int(r[1]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}  # a row for each centroid at most
    total = min(LARGEST, sum(found.values()))
    each = [(c, min(LARGEST, x), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, x in found.items()]
    sums = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return last.withColumnRenamed("id", id_col).join(F.broadcast(sums), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def _sql() -> str:
    """Rounds written out; a vector's components are a list of whole numbers."""
    parts = [
        "e AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), v) - 1)::INTEGER AS c, v AS cv FROM e QUALIFY c < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT u, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT u, c, list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{k}) GROUP BY u)")
        if k < ROUNDS:
            parts.append(f"x{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} JOIN e USING (u)) GROUP BY 1, 2)")
            parts.append(f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mv FROM x{k} GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(mv, cv) AS cv FROM c{k} LEFT JOIN m{k} USING (c))")
    n = ROUNDS
    return f"WITH {', '.join(parts)} SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM a{n} JOIN e USING (u) JOIN c{n} USING (c)"


OP12_SQL = _sql()
