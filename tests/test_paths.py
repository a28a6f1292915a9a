"""Two-hop paths through hubs."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from lodestream.operators import graph


def paths_by_brute_force(edges, least):
    out = [(s, None, t, round(x, 4), g, 1) for s, t, x, g in edges if s != t and round(x, 4) >= least]
    leaves = collections.defaultdict(list)
    for s, t, x, g in edges:
        leaves[s].append((t, x, g))
    for s, m, x, g in edges:
        for t, y, h in leaves[m]:
            if s != m and t not in (s, m) and round(x * y * graph.HOP_DECAY, 4) >= least:
                out.append((s, m, t, round(x * y * graph.HOP_DECAY, 4), g * h, 2))
    return sorted(out, key=str)


def test_hubs_are_dealt_out_and_lose_no_path(spark):
    rng = random.Random(6)
    edges = [(k, 1000, rng.choice([0.001, 0.2, 0.5, 1.0]), rng.choice([1, -1])) for k in range(300)] + [(1000, 2000 + k, rng.choice([0.001, 0.3, 1.0]), 1) for k in range(40)]
    edges += [(rng.randrange(60), rng.randrange(60), rng.random(), rng.choice([1, -1])) for _ in range(300)]
    edges = list({e[:2]: e for e in edges}.values())
    frame = spark.createDataFrame(edges, "source int, target int, edge_score double, sign int")
    got = graph.scored_paths(frame, least=0.05, chunk=16)
    assert sorted((tuple(r) for r in got.collect()), key=str) == paths_by_brute_force(edges, 0.05)


def test_a_large_hub_fills_no_task(spark):
    """Of the pairs at a hub of 20,000 arrivals and 30 departures no group has more than a twentieth."""
    n, chunk = 20_000, 500
    frame = spark.range(n).select(F.col("id").cast("int").alias("source"), F.lit(-1).alias("target"), F.lit(0.5).alias("edge_score"), F.lit(1).alias("sign"))
    frame = frame.union(spark.range(30).select(F.lit(-1), (F.col("id") + 100_000).cast("int"), F.lit(0.5), F.lit(1)))
    out = graph.scored_paths(frame, chunk=chunk)
    assert out.filter("hops = 2").count() == n * 30
    part = F.pmod(F.xxhash64(F.col("source")), F.lit(n // chunk))
    assert out.filter("hops = 2").groupBy(part.alias("i")).count().agg(F.max("count")).first()[0] < n * 30 / 20
