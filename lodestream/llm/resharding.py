"""Resharding by minimum-cost flow.

Old shards hold known numbers of bytes, new shards have capacities.  The flow
from old to new shards that moves the fewest bytes (cost 1 a byte moved, 0 a byte
that stays; any cost matrix may be given) is solved on the matrix of shards, which
is small whatever the data are.  Rows then follow it: inside an old shard they
lie on a line of bytes, largest size classes first, and the flow's amounts cut
that line.  The line is a two-level prefix sum: a window inside small cells
(old shard, size class, hash) and another over the cells' totals, so no task gets
a whole shard.  Small rows (the last ``RESERVE`` of all bytes) are placed by a
second flow after the large rows' true loads are known, so a shard misses its
capacity by small rows only.

A null text has size 1 and crc32 0.  Equal rows are interchangeable.  A row with
a null place of origin belongs to old shard 0.  An empty table gives no rows.
Documents with equal texts may lie in different shards: a group of copies may be
larger than a shard.

Rows are told apart by ``row_id``, a column of docs or else their place in it, so
null and repeated ids are rows like others.  Whoever rewrites an input that isn't
files numbers it first (``numbered``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .storage import table

SHARDS, OLD_SHARDS = 8, 6
#: Hash cells of a size class; rows of all bytes that the second flow places.
CELLS, RESERVE = 64, 0.05
ROW = "row_id"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Units from each source to each sink, all supply sent, at the least total cost (successive shortest paths)."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities don't hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        dist = [0.0 if left[i] else math.inf for i in range(n)] + [math.inf] * m
        come = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j] - 1e-12:
                        dist[n + j], come[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i] - 1e-12:
                        dist[i], come[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        sink = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, at = [], n + sink
        while come[at] >= 0:
            path.append((come[at], at))
            at = come[at]
        send = min([left[at], room[sink], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += send
            else:
                flow[b][a - n] -= send
        left[at] -= send
        room[sink] -= send
    return flow


def even(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def _cuts(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): what moves first, what stays last."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j == i, j)):
            out.append((i, at, at + row[j], j))
            at += row[j]
    return out


def _placed(at: Column, cuts: list[tuple[int, int, int, int]]) -> Column:
    found = F.lit(None).cast("int")
    for i, lo, hi, j in cuts:
        found = F.when((F.col("old_shard") == i) & (at >= lo) & (at < hi), j).otherwise(found)
    return found


def _with_row(docs: DataFrame) -> DataFrame:
    return docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id, written once: the same rows have the same row_id each time it is read."""
    return table(_with_row(docs))


def reshard(docs: DataFrame, old_shard: Column, n_new: int, n_old: int, id_col: str = "doc_id", capacity: list[int] | None = None, cost: list[list[float]] | None = None) -> DataFrame:
    """id_col, row_id, size, text_crc32, old_shard, shard, slot for each row of docs (id_col, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = _with_row(docs).select(ROW, F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"))
    celled = sized.withColumns({"size_class": F.floor(F.log2("size") * 4).cast("int"), "cell": F.pmod(F.xxhash64("id", "text_crc32"), F.lit(CELLS)).cast("int")})
    inside = W.partitionBy("old_shard", "size_class", "cell").orderBy(F.desc("size"), "id", "text_crc32")
    ranked = table(celled.withColumns({"rn": F.row_number().over(inside), "bytes_before": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1))}).fillna({"bytes_before": 0}))

    # at most n_old times 4 * 64 rows come to the driver
    totals = {(r[0], r[1]): r[2] for r in ranked.groupBy("old_shard", "size_class").agg(F.sum("size")).collect()}
    total, below, cut = sum(totals.values()), 0, 0
    for k in sorted({k for _, k in totals}):
        below += sum(v for (_, c), v in totals.items() if c == k)
        cut = k + 1
        if below >= RESERVE * total:
            break
    large = [sum(v for (o, k), v in totals.items() if o == i and k >= cut) for i in range(n_old)]
    small = [sum(v for (o, k), v in totals.items() if o == i and k < cut) for i in range(n_old)]
    capacity = capacity or even(total, n_new)
    cost = cost or [[float(i != j) for j in range(n_new)] for i in range(n_old)]

    plan = min_cost_flow([a + b for a, b in zip(large, small, strict=True)], capacity, cost)
    first = []  # the plan's moves, as far as large rows go; what stays or remains goes to small rows
    for i in range(n_old):
        rest, row = large[i], [0] * n_new
        for j in sorted(range(n_new), key=lambda j: (i == j, j)):
            row[j] = min(plan[i][j], rest)
            rest -= row[j]
        first.append(row)
    cells = ranked.groupBy("old_shard", "size_class", "cell").agg(F.sum("size").alias("cell_bytes"))
    small_col = F.col("size_class") < cut
    along = W.partitionBy("old_shard", small_col).orderBy(F.desc("size_class"), "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_at", F.coalesce(F.sum("cell_bytes").over(along), F.lit(0)))
    lined = ranked.join(F.broadcast(cells.drop("cell_bytes")), ["old_shard", "size_class", "cell"]).withColumn("at", F.col("cell_at") + F.col("bytes_before"))

    loads = {r[0]: r[1] for r in lined.filter(~small_col).groupBy(_placed(F.col("at"), _cuts(first)).alias("s")).agg(F.sum("size")).collect()}
    room = [max(0, capacity[j] - loads.get(j, 0)) for j in range(n_new)]
    lack = sum(small) - sum(room)
    for j in range(n_new):  # rounding: capacities that large rows have overrun
        room[j] += max(0, lack) // n_new + (j < max(0, lack) % n_new)
    second = min_cost_flow(small, room, cost)
    shard = F.when(small_col, _placed(F.col("at"), _cuts(second))).otherwise(_placed(F.col("at"), _cuts(first)))
    placed = lined.select(ROW, "id", "size", "text_crc32", "old_shard", "size_class", "cell", "rn", shard.alias("shard"))
    starts = placed.groupBy("shard", "old_shard", "size_class", "cell").agg(F.count("*").alias("n"), F.min("rn").alias("rn0"))
    before = W.partitionBy("shard").orderBy("old_shard", F.desc("size_class"), "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("shard", "old_shard", "size_class", "cell", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("rn0")).alias("slot0"))
    return placed.join(F.broadcast(starts), ["shard", "old_shard", "size_class", "cell"]).select(F.col("id").alias(id_col), ROW, "size", "text_crc32", "old_shard", "shard", (F.col("slot0") + F.col("rn")).cast("long").alias("slot"))


def rewrite_affected(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes anew, under path, the new shards that gain or lose rows, and deletes those that end with none; a shard whose rows all stay is left as it is.

    docs gives the rows that reshard had, by row_id; a row that differs from its
    assignment stops the job before anything is replaced.
    """
    spark = docs.sparkSession
    moved = assigned.filter("shard <> old_shard")
    touched = {r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()}
    if not touched:
        return
    rows = assigned.filter(F.col("shard").isin(*touched)).select(ROW, "shard", "slot", F.col(id_col).alias("_id"), "size", "text_crc32").withColumnsRenamed({"size": "_size", "text_crc32": "_crc32"})
    filled = {r[0] for r in rows.select("shard").distinct().collect()}

    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("_found") & F.col("_id").eqNullSafe(F.col(id_col)) & (F.col("_size") == F.octet_length(text) + 1) & (F.col("_crc32") == F.crc32(text.cast("binary")))
    slot = F.when(F.coalesce(same, F.lit(False)), F.col("slot")).otherwise(F.raise_error("the rows of docs aren't those that were assigned: number them first").cast("long"))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = rows.join(_with_row(docs).select(*[f"`{c}`" for c in dict.fromkeys([*names, ROW])], F.lit(True).alias("_found")), ROW, "left").withColumn("slot", slot)
    whole.select(*[f"`{c}`" for c in names], "shard", "slot").repartition("shard", F.pmod("slot", F.lit(64))).sortWithinPartitions("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for k in touched - filled:  # a dynamic overwrite replaces partitions that get rows only
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 6 shards by source (one of them far too large) to 8 shards of equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = reshard(docs, F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)), SHARDS, OLD_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
