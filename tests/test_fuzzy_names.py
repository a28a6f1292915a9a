"""Fuzzy names of one pattern, by brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.operators import entities as E


@pytest.mark.parametrize("block", [7, 20_000])
def test_fuzzy_names_of_one_pattern(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    mentions = [f"customer{i}" for i in range(0, 60, 3)] + ["MACHINERYS", " toolshop ", "zzz", "", None, "customer3", "é"]
    names = [(f"Customer#{i:09d}", i % 5) for i in range(40)] + [("MACHINERY", 1000), ("machinery", 1000), ("Toolshop", None), ("tool shop", 7), (None, 3), ("", 9), ("É", 4)]
    m = spark.createDataFrame([(x,) for x in mentions], "mention string")
    n = spark.createDataFrame(names, "name string, concept long")
    out = E.fuzzy_resolved(m, n)
    got = {r["mention"]: (round(r["similarity"], 9), r["concept"], r["confidence"]) for r in out.collect()}
    hashed = {r["concept"]: r["h"] for r in n.select("concept", F.xxhash64("concept").alias("h")).collect()}

    def grams(x):
        p = f"  {x.strip().lower()} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    want = {}
    for x in {x for x in mentions if x is not None}:
        s = [(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), -hashed[c], c) for y, c in names if y is not None]
        s = [t for t in s if t[0] >= E.TRIGRAM_LEAST]
        if s:
            best = max(s, key=lambda t: t[:2])
            want[x] = (round(best[0], 9), best[2], E.ONE_CANDIDATE if len({t[2] for t in s}) == 1 else E.MORE_CANDIDATES)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
@pytest.mark.parametrize("kind", ["pattern", "words", "any"])
def test_nearest_is_exact(monkeypatch, cells, kind):
    """A block by brute force: names of one pattern, names of few words, and texts of any letters; ties go to the least hash."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(E, "CELLS", cells)
    rng = random.Random(f"{kind}")

    def text():
        if kind == "pattern":
            return f"Customer#{rng.randrange(3000):09d}" if rng.random() < 0.5 else f"customer{rng.randrange(3000)}"
        if kind == "words":
            return " ".join(rng.choices(["north", "south", "steel", "bank", "of", "union", "é"], k=rng.randrange(4)))
        return "".join(rng.choices("abcé😀 ", k=rng.randrange(9)))

    padded = lambda x: f"  {x.strip().lower()} "
    mentions = list({text() for _ in range(60)})
    names = [(padded(text()), c, c * 7919 % 101 - 50) for c in (rng.randrange(3 if kind == "any" else 9) for _ in range(150))]
    m = pa.table({"mention": mentions, "p": [padded(x) for x in mentions]})
    n = pa.table({"concept": pa.array([c for _, c, _ in names], pa.int64()), "h": pa.array([h for *_, h in names], pa.int64()), "p": [x for x, *_ in names]})
    grams = lambda p: {p[i : i + 3] for i in range(len(p) - 2)}
    for least in (0.4, 0.7):
        got: dict = {}
        for r in E._nearest(m, n, least).to_pylist():
            got.setdefault(r["mention"], []).append((r["similarity"], -r["h"], r["concept"]))
        for x in mentions:
            s = [t for p, c, h in names if (t := (len(grams(padded(x)) & grams(p)) / len(grams(padded(x)) | grams(p)), -h, c))[0] >= least]
            found = got.pop(x, [])
            assert bool(found) == bool(s)
            if s:
                assert max(found) == max(s) and len({c for *_, c in found}) == len(found) == min(2, len({c for *_, c in s}))
                assert {c for *_, c in found} <= {c for *_, c in s}
        assert not got


def test_names_of_one_pattern_are_not_compared_one_by_one(monkeypatch):
    """Frequent trigrams are compared by classes, so what a block looks at is a small share of its pairs."""
    import numpy as np
    import pyarrow as pa

    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(E.np, "bitwise_count", lambda x: seen.append(x.size) or count(x))
    k = range(3000)
    m = pa.table({"mention": [f"customer{i}" for i in k], "p": [f"  customer{i} " for i in k]})
    n = pa.table({"concept": pa.array([i % 25 for i in k], pa.int64()), "h": pa.array([i % 25 for i in k], pa.int64()), "p": [f"  customer#{i:09d} " for i in k]})
    assert E._nearest(m, n, 0.4).num_rows == 6000 and 0 < sum(seen) < 3000 * 3000 / 20
