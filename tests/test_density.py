"""The vector index and density clusters against brute force."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import density, vector_index

from .conftest import SF


def blobs(rng, n, k, dims=8, spread=0.08):
    centres = rng.normal(size=(k, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres[rng.integers(0, k, n)] + rng.normal(size=(n, dims)) * spread).astype(np.float32)


def distances(v):
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    return np.round(np.sqrt(np.maximum(0, 2 - 2 * (u @ u.T))), 9)


def clusters_by_brute_force(v, k, samples, least, levels, complete=False):
    """Groups of row numbers, by Kruskal over all edges and a recursion over levels; every vector is a node, equal ones included."""
    kinds = {}
    for i, x in enumerate(v):
        kinds.setdefault(tuple(x.tolist()), []).append(i)
    nodes, size = list(kinds.values()), [len(m) for m in kinds.values()]
    d = distances(np.array([list(x) for x in kinds], np.float32))
    near, core = [], []
    for i in range(len(nodes)):
        others = sorted((d[i, j], j) for j in range(len(nodes)) if j != i)
        near.append(others if complete else others[:k])
        seen, c = size[i], 0.0 if size[i] >= samples else None
        for w, j in others if complete else others[:k]:
            seen += size[j]
            if c is None and seen >= samples:
                c = w
        core.append(c if c is not None else max((w for w, _ in near[-1]), default=0.0))
    edges = sorted({(max(w, core[i], core[j]), min(i, j), max(i, j)) for i in range(len(nodes)) for w, j in near[i]})
    step = 2.0 / levels
    lam = lambda level: 1 / (max(level, 0.5) * step)
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cluster = {i: None for i in range(len(nodes))}
    held = {i: [i] for i in range(len(nodes))}
    made = []  # of each cluster: its children, gains (level, vectors), nodes
    birth = {}

    def begin(children):
        made.append({"children": children, "gains": [], "nodes": []})
        return len(made) - 1

    def join(c, level, members):
        made[c]["gains"].append((level, sum(size[i] for i in members)))
        made[c]["nodes"] += members

    for i in range(len(nodes)):
        if size[i] >= least:
            cluster[i] = begin([])
            join(cluster[i], 0, [i])
    for level in range(levels + 1):
        groups = collections.defaultdict(set)
        for w, i, j in edges:
            if math.ceil(round(w / step, 9)) == level:
                a, b = top(i), top(j)
                if a != b:
                    mine = groups.pop(a, {a}) | groups.pop(b, {b})
                    parent[max(a, b)] = min(a, b)
                    groups[min(a, b)] = mine
        for root, parts in groups.items():
            bigs = [cluster[p] for p in parts if cluster[p] is not None]
            total = sum(sum(size[i] for i in held[p]) for p in parts)
            new = bigs[0] if len(bigs) == 1 else begin(bigs) if total >= least else None
            if new is not None and len(bigs) != 1:
                for b in bigs:
                    birth[b] = level
            for p in parts:
                if new is not None and cluster[p] is None:
                    join(new, level, held[p])
            held[root] = [i for p in parts for i in held.pop(p)]
            cluster[root] = new
    whole = lambda c: sum(n for _, n in made[c]["gains"]) + sum(whole(x) for x in made[c]["children"])
    roots = [c for c in range(len(made)) if c not in birth]

    def stable(c):
        if c not in birth and len(roots) == 1:
            return -1.0
        start = lam(birth[c]) if c in birth else 0.0
        return round(sum(n * lam(x) for x, n in made[c]["gains"]) + sum(whole(x) * lam(birth[x]) for x in made[c]["children"]) - whole(c) * start, 9)

    def best(c):
        below = [best(x) for x in made[c]["children"]]
        total = round(sum(x for x, _ in below), 9)
        if below and stable(c) < total:
            return total, [g for _, gs in below for g in gs]
        return stable(c), [c] if stable(c) >= 0 else []

    every = lambda c: made[c]["nodes"] + [i for x in made[c]["children"] for i in every(x)]
    return sorted(sorted(i for n in every(c) for i in nodes[n]) for r in roots for c in best(r)[1])


def groups(out):
    found = collections.defaultdict(list)
    for r in out.collect():
        if r["cluster"] is not None:
            found[r["cluster"]].append(r["vec_id"])
            assert r["members"] > 0
    assert all(c == min(m) for c, m in found.items())
    return sorted(sorted(m) for m in found.values())


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("case", ["blobs", "noise", "copies"])
def test_density_clusters_against_brute_force(spark, case):
    rng = np.random.default_rng({"blobs": 1, "noise": 2, "copies": 3}[case])
    v = {"blobs": lambda: blobs(rng, 500, 7, spread=0.05), "noise": lambda: rng.normal(size=(150, 4)).astype(np.float32), "copies": lambda: np.concatenate([blobs(rng, 90, 3), np.repeat(blobs(rng, 3, 3), [40, 7, 3], axis=0)])}[case]()
    got = groups(density.density_clusters(frame(spark, v), k=10, samples=4, least=8, levels=24, probes=99, cells=5))
    assert got == clusters_by_brute_force(v, 10, 4, 8, 24)
    if case == "blobs":  # as the tree over all pairs has them
        assert got == clusters_by_brute_force(v, 10, 4, 8, 24, complete=True)


def test_spanning_forest_weighs_the_least(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(min(a, b)), int(max(a, b)), float(rng.integers(1, 6))) for a, b in rng.integers(0, 40, (150, 2)) if a != b}, key=lambda e: e[:2])
    edges = list({e[:2]: e for e in edges}.values())
    parent, want = list(range(40)), []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[x] = y
            want.append((a, b, w))
    got = density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_blocks_of_a_full_cell_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 16)
    v = blobs(np.random.default_rng(9), 120, 2)
    nodes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "node long, n long, vector array<float>")
    got = collections.defaultdict(list)
    for r in density.neighbours(nodes, 6, 9, 2).collect():
        got[r["node"]].append((r["d"], r["other"]))
    d = distances(v)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted((d[i, j], j) for j in range(120) if j != i)[:6] for i in range(120)}


def test_odd_vectors_have_no_cluster(spark):
    v = blobs(np.random.default_rng(4), 60, 2)
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)] + [(100, None, "c"), (101, [], "c"), (102, [0.0] * 8, "c"), (103, [None] + [1.0] * 7, "c"), (104, [float("nan")] * 8, "c"), (105, [float("inf")] * 8, "c"), (0, v[0].tolist(), "c"), (None, v[1].tolist(), "c")]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    out = density.density_clusters(odd, k=5, samples=3, least=5, probes=9, cells=2).collect()
    assert len(out) == len(rows) and all(r["cluster"] is None for r in out if r["vec_id"] is not None and r["vec_id"] >= 100) and sum(r["cluster"] is not None for r in out) > 40
    assert density.density_clusters(odd.limit(0)).count() == 0
    index = vector_index.build(odd, cells=3)
    found = vector_index.search(spark, index, odd.select(F.col("vec_id").alias("query"), "embedding"), 3, 0.9)
    assert found.filter("query >= 100 or vec_id >= 100").count() == 0 and found.count() > 100
    empty = vector_index.build(odd.limit(0))
    assert vector_index.search(spark, empty, odd.select(F.col("vec_id").alias("query"), "embedding"), 3, 0.9).count() == 0


def test_a_search_reads_few_partitions(spark):
    """Exact without probes; with them, recall is measured against brute force; the plan prunes cells."""
    v = blobs(np.random.default_rng(6), 2000, 20, dims=16, spread=0.12)
    rows = frame(spark, v)
    index = vector_index.build(rows, cells=20)
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 2000, 50) for j in sorted((j for j in range(2000) if j != i), key=lambda j: (-round(float(u[i].astype(float) @ u[j].astype(float)), 6), j))[:10]}
    exact = {(r["query"], r["vec_id"]) for r in vector_index.search(spark, index, queries, 10, -1.0).collect()}
    assert len(exact & want) >= 0.999 * len(want)
    near = vector_index.search(spark, index, queries, 10, -1.0, probes=3)
    assert len({(r["query"], r["vec_id"]) for r in near.collect()} & exact) >= 0.95 * len(exact)
    one = vector_index.search(spark, index, queries.filter("query = 0"), 10, 0.8)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert len(read) <= 20 and one.count() == 10


def test_recall_on_the_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    index = vector_index.build(e, cells=8)
    exact = {(r["query"], r["vec_id"]) for r in vector_index.search(spark, index, queries, 10, -1.0).collect()}
    near = {(r["query"], r["vec_id"]) for r in vector_index.search(spark, index, queries, 10, -1.0, probes=6).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def jobs_of(spark, run):
    """What run returns, and how many Spark jobs it started."""
    name = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_forest_takes_few_jobs(spark):
    """Rounds of joins took 194 jobs for these edges."""
    edges = [(i, j, float((i * 31 + j * 17) % 101)) for i in range(400) for j in range(i + 1, min(400, i + 4))]
    rows, jobs = jobs_of(spark, lambda: density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).count())
    assert rows == 399 and jobs <= 12


@pytest.mark.parametrize("most", [200])
def test_graphs_of_more_edges_than_a_task_holds(spark, monkeypatch, most):
    v = blobs(np.random.default_rng(11), 260, 5, spread=0.05)
    monkeypatch.setattr(density, "EDGES", most)
    got = groups(density.density_clusters(frame(spark, v), k=8, samples=3, least=6, levels=24, probes=99, cells=3))
    assert got == clusters_by_brute_force(v, 8, 3, 6, 24)


def test_roots_of_blocks_against_components():
    rng = np.random.default_rng(12)
    for n, m in ((1, 0), (2, 1), (40, 30), (60, 200), (300, 310)):
        x, y = rng.integers(0, n, m) * 7 - 50, rng.integers(0, n, m) * 7 - 50
        at, own = rng.integers(0, 6, m), {}
        got = sorted(zip(*(c.tolist() for c in density.joined(x, y, at)), strict=True), key=lambda r: r[2])
        keep, top = density.lightest(x, y), {k: k for k in {*x.tolist(), *y.tolist()}}
        for i in range(m):  # the edges in their order: Kruskal
            assert keep[i] == (top[x[i]] != top[y[i]])
            old, new = max(top[x[i]], top[y[i]]), min(top[x[i]], top[y[i]])
            top = {k: new if t == old else t for k, t in top.items()}
        for place in range(6):
            whole = {k: k for k in top}
            for i in np.flatnonzero(at <= place):
                old, new = max(whole[x[i]], whole[y[i]]), min(whole[x[i]], whole[y[i]])
                whole = {k: new if t == old else t for k, t in whole.items()}
            own |= {node: root for node, root, p in got if p == place}
            assert whole == {k: own.get(k, k) for k in whole}


def test_first_columns_as_a_whole_sort_has_them():
    rng = np.random.default_rng(13)
    for d in (rng.normal(size=(40, 30)), rng.integers(0, 4, (40, 30)).astype(float), np.where(rng.random((40, 30)) < 0.7, np.inf, rng.random((40, 30))), np.zeros((0, 5))):
        for k in (1, 4, 29, 40):
            assert (vector_index.first(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()
