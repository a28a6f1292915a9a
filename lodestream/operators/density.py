"""Density clusters of vectors: nearest neighbours, mutual reachability, a spanning forest, its condensed tree.

Neighbours are found through coarse cells (``vector_index``): a vector visits its
``probes`` nearest cells and is compared with their members in blocks of bounded size;
only its nearest ones leave a block.  Equal vectors are one node that counts as often
as it occurs, so copies cost nothing.  The mutual reachability of two neighbours is the
largest of their distance and both core distances (that to the ``samples``-th
vector, itself counted).  Boruvka rounds reduce these edges to a spanning forest: every component
takes its least edge, the components these connect are contracted, of parallel edges the least stays.

The tree of components over falling density is cut into ``levels`` steps of distance
between 0 and 2 (the widest between unit vectors); all that merges within a step
merges at once.  A step is one contraction of the edges of that level by joins and
sums; components below ``least`` vectors carry their members along (fewer than ``least``), larger
ones carry the cluster they belong to.  Two or more of these meeting is a split, and each is a cluster of
the condensed tree.  Clusters are chosen by excess of mass, from the bottom up, level by level,
and a vector's cluster is the topmost chosen one above it.  Nothing but the list
of levels and the coarse centroids comes to the driver, no group is collected but those of less than
``least`` vectors.

A tree that spans everything has one root, which is never chosen; where the forest has several trees,
their roots may be.  Vectors that ``vector_index`` can't take (null, zeros, NaN) and
vectors outside every chosen cluster have no cluster.  A vector with fewer neighbours than
``samples`` takes its farthest one.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import discard, table
from .graph import components
from .vector_index import celled, first, fit, usable
from .vectors import matrix, unit

#: Usual values: neighbours in the graph, those of a core distance, vectors of a cluster.
NEIGHBOURS, SAMPLES, LEAST, LEVELS, PROBES = 15, 5, 10, 40, 8
#: Vectors of a cell, and those that are compared with as many others at once.
PER_CELL, BLOCK = 256, 1024
#: Edges that a task holds at once (their five numbers are 20 MB): no more are left to one task, of more each task has a part.
EDGES = 1 << 19
WIDEST = 2.0
#: More than the levels there may be; a component's code is its root times so many, plus its level's place.
CODES = 1 << 10


def neighbours(nodes: DataFrame, k: int, probes: int, cells: int | None = None) -> DataFrame:
    """node, n, other, other_n, d: the k nearest other nodes of each node (node, n, vector) among the cells it visits."""
    named = nodes.select(F.struct("node", "n").alias("id"), "vector")
    centroids = fit(named, "id", "vector", cells, PER_CELL)
    schema = "node long, n long, other long, other_n long, d double"
    if not len(centroids):
        return nodes.sparkSession.createDataFrame([], schema)
    placed = table(celled(named, centroids, "id", "vector", max(2, probes)).select("id.node", "id.n", "vector", "cell", "cells"))
    visits = placed.select("node", "n", "vector", F.explode("cells").alias("cell"))
    home = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("homes"))  # as many rows as cells
    guests = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("guests"))
    sizes = home.join(guests, "cell")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.join(F.broadcast(sizes), "cell").select("cell", at("homes").alias("h"), every("guests").alias("g"), F.lit(False).alias("guest"), "node", "n", "vector")
    coming = visits.join(F.broadcast(sizes), "cell").select("cell", every("homes").alias("h"), at("guests").alias("g"), F.lit(True).alias("guest"), "node", "n", "vector")

    def nearest(group: pa.Table) -> pa.Table:
        guest = group.column("guest").to_numpy()
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        v = unit(matrix(group.column("vector").combine_chunks()))
        here = np.flatnonzero(~guest)
        here = here[np.argsort(node[here])]
        out = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        who = np.flatnonzero(guest)
        if len(who) and len(here):
            d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * (v[who] @ v[here].T))), 9)
            d[node[who][:, None] == node[here]] = np.inf
            near = first(d, k)
            row = np.repeat(np.arange(len(who)), near.shape[1])
            found = np.isfinite(d[row, near.ravel()])
            row, col = row[found], near.ravel()[found]
            out = [node[who[row]], n[who[row]], node[here[col]], n[here[col]], d[row, col]]
        return pa.table(out, names=["node", "n", "other", "other_n", "d"])

    found = members.unionByName(coming).groupBy("cell", "h", "g").applyInArrow(nearest, schema)
    rank = F.row_number().over(W.partitionBy("node").orderBy("d", "other"))  # k rows a block that a node visits
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """a < b, w: mutual reachability of neighbours (node, n, other, other_n, d)."""
    seen = F.col("n") + F.sum("other_n").over(W.partitionBy("node").orderBy("d", "other").rowsBetween(W.unboundedPreceding, 0))
    core = near.withColumn("seen", seen).groupBy("node").agg(F.when(F.max("n") >= samples, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("seen") >= samples, F.col("d"))), F.max("d"))).alias("core"))
    pairs = near.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("d").alias("d"))
    # a node that is somebody's neighbour has neighbours itself
    return pairs.join(core.select(F.col("node").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("node").alias("b"), F.col("core").alias("cb")), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def lightest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges (x, y), given from the lightest on, the least spanning forest has."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    keep, live, every = np.zeros(len(x), bool), np.arange(len(x)), np.arange(len(names))
    own = every
    while True:
        u, v = own[x[live]], own[y[live]]
        live, u, v = live[u != v], u[u != v], v[u != v]
        if not len(live):
            return keep
        best = np.full(len(names), len(x))
        np.minimum.at(best, u, live)
        np.minimum.at(best, v, live)
        who = np.flatnonzero(best < len(x))
        e = best[who]
        keep[e] = True
        to = every.copy()
        to[who] = own[x[e]] + own[y[e]] - who
        to = np.where((to[to] == every) & (every < to), every, to)  # two that take the same edge
        own = _tops(to)[own]


def _tops(to: np.ndarray) -> np.ndarray:
    while (up := to[to]).tobytes() != to.tobytes():
        to = up
    return to


def joined(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, root, at: whenever the least node that edges of that place or a lower one connect with a node becomes another."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    own, out = np.arange(len(names)), []
    for place in np.unique(at):
        x, y, before = a[at == place], b[at == place], own
        while len(x):
            u, v = own[x], own[y]
            x, y, u, v = x[u != v], y[u != v], u[u != v], v[u != v]
            to = np.arange(len(names))
            np.minimum.at(to, np.maximum(u, v), np.minimum(u, v))
            own = _tops(to)[own]
        moved = np.flatnonzero(own != before)
        out.append((names[moved], names[own[moved]], np.full(len(moved), place)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)) if out else (names, names, names)


def _blocks(batches, most: int):
    """Batches in tables of ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
            if rows == most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (x, y, a, b, w) without those that aren't in the least spanning forest of the block of EDGES they are in, so in none of the whole."""
    most = EDGES

    def run(batches):
        for t in _blocks(batches, most):
            t = t.take(np.lexsort([t.column(c).to_numpy() for c in ("b", "a", "w")]))
            yield from t.filter(pa.array(lightest(t.column("x").to_numpy(), t.column("y").to_numpy()))).to_batches()

    return edges.mapInArrow(run, edges.schema)


def joins_at(edges: DataFrame) -> DataFrame:
    """``joined`` of EDGES edges (a, b, at) at most, by one task."""

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(joined(*(t.column(c).to_numpy() for c in ("a", "b", "at"))), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["node", "root", "at"])

    return edges.select("a", "b", "at").coalesce(1).mapInArrow(run, "node long, root long, at int")


def linked(edges: DataFrame) -> DataFrame:
    """``components`` of edges (a, b) that are a table: by one task if they are EDGES at most."""
    if edges.count() > EDGES:
        return components(edges)
    return table(joins_at(edges.withColumn("at", F.lit(0))).select(F.col("node").alias("a"), F.col("root").alias("b")))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the least spanning forest; equal weights count by a and b."""
    now = table(edges.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "w"))
    out = []
    while (left := now.count()) > EDGES:
        ends = [now.select(F.col(x).alias("x"), F.struct("w", "a", "b", F.col(y).alias("y")).alias("e")) for x, y in ("xy", "yx")]
        least = table(ends[0].union(ends[1]).groupBy("x").agg(F.min("e").alias("e")).select("x", "e.*"))
        out.append(least.select("a", "b", "w").distinct())
        part = linked(least.select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = relabelled(now, part, "x", "y").filter("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        last, now = now, table(thinned(moved.select("x", "y", "e.a", "e.b", "e.w").repartition(-(-left // EDGES))))
        discard(last, part)
    found = thinned(now.coalesce(1)).select("a", "b", "w")
    for part in out:
        found = found.union(part)
    return table(found)


def relabelled(edges: DataFrame, part: DataFrame, *ends: str) -> DataFrame:
    """Edges whose ends are what part (a, b: a lies in b) makes of them."""
    for end in ends:
        edges = edges.join(part.select(F.col("a").alias(end), F.col("b").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def root_changes(nodes: DataFrame, edges: DataFrame, counts: list[int]) -> DataFrame:
    """node, root, at: the least node of each node's component, whenever it becomes another: itself from -1 on, others from the place at which they meet.

    edges: a, b, at of a forest, counts[at] of each place.  Places are taken one after another, contracted, until no more than EDGES are left.
    """
    out = nodes.select("node", F.col("node").alias("root"), F.lit(-1).alias("at"))
    own, now, left = nodes.select("node", F.col("node").alias("root")), edges, sum(counts)
    for place, n in enumerate(counts):
        if left <= EDGES:
            break
        if n:
            part = linked(table(now.filter(F.col("at") == place).select("a", "b")))
            out = out.union(own.join(part.select(F.col("a").alias("root"), F.col("b").alias("to")), "root").select("node", "to", F.lit(place)))
            own, now, left = table(relabelled(own, part, "root").select("node", "root")), table(relabelled(now.filter(F.col("at") > place), part, "a", "b").select("a", "b", "at")), left - n
    rest = table(joins_at(now)).select(F.col("node").alias("root"), F.col("root").alias("to"), "at")
    return out.union(own.join(rest, "root").select("node", "to", "at"))


def density(level: Column, levels: int) -> Column:
    return 1 / (F.greatest(level.cast("double"), F.lit(0.5)) * (WIDEST / levels))


def condensed(nodes: DataFrame, forest: DataFrame, least: int, levels: int) -> tuple[list[int], DataFrame, DataFrame]:
    """The levels that occur, who joins which cluster when (node, n, at, cluster), and splits (cluster, parent, born, size).

    at and born are places in the list of levels.  A cluster is named by its first component: root * CODES + place.
    """
    level = F.ceil(F.round(F.col("w") / (WIDEST / levels), 9)).cast("int")
    edges = table(forest.select("a", "b", level.alias("level")))
    counts = {0: 0} | dict(map(tuple, edges.groupBy("level").count().collect()))  # levels + 1 at most
    found = sorted(counts)
    at = (F.array_position(F.array(*[F.lit(x) for x in found]), F.col("level")) - 1).cast("int")
    code = lambda v, at: F.col(v) * CODES + F.col(at)
    changes = table(root_changes(nodes, edges.select("a", "b", at.alias("at")), [counts[x] for x in found]).join(nodes.select("node", "n"), "node"))
    until = F.lead("at", 1, len(found)).over(W.partitionBy("node").orderBy("at")) - 1
    spans = table(changes.withColumn("until", until))  # a root is its own from -1 on, until it lies in another
    ends = spans.filter("node = root").select("root", F.col("until").alias("end"))
    gains = spans.groupBy("root", "at").agg(F.sum("n").alias("n"))
    by_root = W.partitionBy("root").orderBy("at")
    grown = gains.select("root", "at", F.sum("n").over(by_root).alias("size"), F.lead("at").over(by_root).alias("next")).filter(F.col("size") >= least)
    stretches = grown.join(ends, "root").select("root", "size", F.greatest("at", F.lit(0)).alias("from"), F.coalesce(F.col("next") - 1, "end").alias("to")).filter(F.col("from") <= F.col("to"))
    sizes = table(stretches.select("root", "size", F.explode(F.sequence("from", "to")).alias("at")))
    above = spans.filter("until >= 0").join(sizes.select(F.col("root").alias("node")).distinct(), "node")
    above = above.select("node", "root", F.explode(F.sequence(F.greatest("at", F.lit(0)), "until")).alias("at"))
    up = above.filter("at > 0").select(F.col("node").alias("root"), (F.col("at") - 1).alias("at"), F.col("root").alias("above"))
    big = table(sizes.join(up, ["root", "at"], "left"))
    kids = big.filter("above is not null").groupBy(F.col("above").alias("root"), (F.col("at") + 1).alias("at")).agg(F.count("*").alias("kids"), F.max("root").alias("kid"))
    big = table(big.join(kids, ["root", "at"], "left").withColumn("code", code("root", "at")))
    head = F.when(F.col("kids") == 1, F.col("kid") * CODES + F.col("at") - 1).otherwise(F.col("code"))
    names = table(big.select("code", head.alias("cluster")))
    for _ in range(len(found).bit_length()):  # what goes on is named like what it began with
        last, names = names, table(names.join(names.select(F.col("code").alias("cluster"), F.col("cluster").alias("_to")), "cluster").select("code", F.col("_to").alias("cluster")))
        discard(last)
    large = sizes.groupBy("root").agg(F.min("at").alias("from"))  # a root only grows
    first = spans.join(large, "root").withColumn("at", F.greatest("at", "from")).filter("at <= until").groupBy("node", "n").agg(F.min(F.struct("at", "root")).alias("s"))
    joins = first.select("node", "n", "s.at", code("s.root", "s.at").alias("code")).join(names, "code").select("node", "n", "at", "cluster")
    parents = big.filter("kids > 1").select(F.col("code").alias("up"))
    splits = big.withColumn("up", F.col("above") * CODES + F.col("at") + 1).join(parents, "up").join(names, "code").join(names.select(F.col("code").alias("up"), F.col("cluster").alias("parent")), "up")
    return found, table(joins), table(splits.select("cluster", "parent", (F.col("at") + 1).alias("born"), "size"))


def chosen(found: list[int], joins: DataFrame, splits: DataFrame, levels: int) -> DataFrame:
    """cluster, label: the topmost chosen cluster at or above each cluster, by excess of mass."""
    dense = lambda at: density(F.element_at(F.array(*[F.lit(x) for x in found]), (F.col(at) + 1).cast("int")), levels)
    gained = joins.select("cluster", F.col("n").alias("size"), dense("at").alias("d")).union(splits.select("parent", "size", dense("born")))
    own = gained.groupBy("cluster").agg(F.sum("size").alias("total"), F.sum(F.col("size") * F.col("d")).alias("mass")).join(splits.select("cluster", "parent", "born"), "cluster", "left")
    own = table(own)
    tops = own.filter("parent is null").count()
    # of several trees a root's density starts at 0
    stable = F.when(F.col("parent").isNotNull(), F.col("mass") - F.col("total") * dense("born")).otherwise(F.col("mass") if tops > 1 else F.lit(-1.0))
    now = table(own.select("cluster", "parent", "born", F.round(stable, 9).alias("stable"), F.pmod("cluster", F.lit(CODES)).cast("int").alias("made")))
    done = now.limit(0).select("cluster", "parent", "born", "stable", F.lit(0.0).alias("value"), F.lit(True).alias("good"))
    for at in sorted(r[0] for r in now.select("made").distinct().collect()):  # children end where their parent begins
        below = done.filter(F.col("born") == at).groupBy(F.col("parent").alias("cluster")).agg(F.round(F.sum("value"), 9).alias("below"))
        better = F.col("below").isNull() | (F.col("stable") >= F.col("below"))
        part = now.filter(F.col("made") == at).join(below, "cluster", "left")
        done = done.union(table(part.select("cluster", "parent", "born", "stable", F.when(better, F.col("stable")).otherwise(F.col("below")).alias("value"), (better & (F.col("stable") >= 0)).alias("good"))))
    up = table(done.select("cluster", F.col("parent").alias("up"), F.when(F.col("good"), F.col("cluster")).alias("label")))
    while up.filter("up is not null").limit(1).count():  # a cluster lies in as many others as there are levels at most
        above = up.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("label").alias("_label"))
        last, up = up, table(up.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_label", "label").alias("label")))
        discard(last)
    return up


def density_clusters(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, samples: int = SAMPLES, least: int = LEAST, levels: int = LEVELS, probes: int = PROBES, cells: int | None = None) -> DataFrame:
    """id, cluster (the least id in it, null outside of all), members of every row."""
    kept = rows.select(id_col, F.when(usable(vector), F.col(vector).cast("array<float>")).alias("vector"))
    nodes = table(kept.filter("vector is not null").groupBy("vector").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    near = table(neighbours(nodes, k, probes, cells))
    forest = spanning_forest(reachability(near, samples))
    found, joins, splits = condensed(nodes, forest, least, levels)
    labels = joins.join(chosen(found, joins, splits, levels), "cluster").filter("label is not null").select("node", "label")
    out = table(kept.join(nodes.join(labels, "node").select("vector", "label"), "vector", "left").select(id_col, "label"))
    names = out.filter("label is not null").groupBy("label").agg(F.min(id_col).alias("cluster"), F.count("*").alias("members"))
    return out.join(names, "label", "left").select(id_col, "cluster", "members")
