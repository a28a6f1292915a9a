"""The store of signatures against documents taken one after another."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import signature_store as S
from lodestream.operators.vectors import BANDS, PERMUTATIONS, minhashed

BEGIN = dt.datetime(2026, 1, 1)


def documents(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        text = " ".join(w)
        rows.append((k, rng.choice([text, text, text.upper() + "!", f"{text}."]), BEGIN + dt.timedelta(minutes=k)))
    return [*rows, (n, None, BEGIN + dt.timedelta(minutes=n)), (n + 1, "", BEGIN + dt.timedelta(minutes=n + 1)), (n + 2, "?!", BEGIN + dt.timedelta(minutes=n + 2)), (None, "lonely text without an id here", BEGIN + dt.timedelta(minutes=n + 3))]


SCHEMA = "doc_id long, text string, at timestamp"


def one_after_another(spark, rows):
    frame = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "k long, text string")
    hashed = frame.select("k", S.shingles(F.coalesce("text", F.lit(""))).alias("h")).filter("size(h) > 0")
    signed = {r["k"]: np.array(r["signature"]) for r in minhashed(hashed, "k").collect()}
    width, kept, prints, out = PERMUTATIONS // BANDS, [], {}, []
    for k, (i, t, _) in enumerate(rows):
        if (t or "") in prints:
            out.append((i, "exact", prints[t or ""]))
            continue
        best = None
        for j in kept if k in signed else ():
            a, b = signed[k].reshape(-1, width), signed[j].reshape(-1, width)
            share = float((a == b).mean())
            if (a == b).all(axis=1).any() and share >= S.THRESHOLD:
                best = min(best or (1,), (-share, len(str(rows[j][0])), str(rows[j][0]), rows[j][0]))
        if best:
            out.append((i, "near", best[3]))
        else:
            prints[t or ""] = i
            out.append((i, None, i))
            if k in signed:
                kept.append(k)
    return sorted(out, key=str)


def decided(*frames):
    return sorted(((r["doc_id"], r["duplicate"], r["canonical"]) for f in frames for r in f.collect()), key=str)


def test_batches_and_one_run_are_the_sequence(spark, tmp_path):
    rows = documents(1)
    want = one_after_another(spark, rows)
    assert {k for _, k, _ in want} == {None, "exact", "near"}
    frame = lambda r: spark.createDataFrame(r, SCHEMA).repartition(3)
    whole = S.add_batch(spark, S.SignatureStore(f"file://{tmp_path}/one"), frame(rows), 0, "at")
    assert decided(whole) == want
    store = S.SignatureStore(f"file://{tmp_path}/three")
    parts = [S.add_batch(spark, store, frame(rows[a:b]), e, "at") for e, (a, b) in enumerate([(0, 35), (35, 60), (60, len(rows))])]
    assert decided(*parts) == want
    again = S.add_batch(spark, store, frame(rows[35:60]), 1, "at")  # a replay sees earlier batches only and replaces its own folders
    assert decided(again) == decided(parts[1]) and store.read(spark, "documents", 9).count() == len(rows)


def test_blocks_find_every_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, PERMUTATIONS)
    signed = []
    for _ in range(25):
        x = base.copy()
        x[rng.choice(np.arange(4, PERMUTATIONS), rng.integers(0, 20), replace=False)] = 99
        signed.append(x)
    nodes = spark.createDataFrame([(f"n{k}", f"{k:03d}", x.tolist()) for k, x in enumerate(signed)], "node string, rank string, signature array<long>")
    bands = nodes.select("node", F.explode(S.bands_of()).alias("band"))
    got = {(r["a"], r["b"]) for r in S.similar_pairs(nodes, bands, 0.9).collect()}
    assert got == {(f"n{i}", f"n{j}") for i in range(25) for j in range(i + 1, 25) if (signed[i] == signed[j]).mean() >= 0.9}


def test_shingles_are_runs_of_three_and_single_words_of_short_texts(spark):
    frame = spark.createDataFrame([("a b c d e f",), ("a, b! c",), ("one",), ("?",), (None,)], "text string")
    sizes = [r[0] for r in frame.select(F.size(S.shingles(F.coalesce("text", F.lit(""))))).collect()]
    assert sizes == [4, 4, 1, 0, 0] and re.sub(r"\W", "", "a, b! c") == "abc"


def test_old_documents_are_looked_up_no_more(spark, tmp_path):
    rows = documents(3, 20)
    store = S.SignatureStore(f"file://{tmp_path}/store")
    frame = spark.createDataFrame(rows, SCHEMA)
    later = spark.createDataFrame([(1000 + (k or 0), t, a + dt.timedelta(days=9)) for k, t, a in rows], SCHEMA)
    first = S.add_batch(spark, store, frame, 0, "at")
    kept = first.filter("duplicate is null").count()
    young = S.add_batch(spark, store, later, 1, "at", since=BEGIN + dt.timedelta(days=5))
    assert young.filter("duplicate is null").count() == kept
    assert S.expire(spark, store, BEGIN + dt.timedelta(days=5)) == [0] and store.read(spark, "kept", 9).select("epoch").distinct().count() == 1
    assert S.expire(spark, S.SignatureStore(f"file://{tmp_path}/none"), BEGIN) == []
    assert S.add_batch(spark, store, frame.limit(0), 2, "at").count() == 0


def test_similar_signatures_share_a_part_and_others_hardly_meet(spark):
    """Parts are as many as leave one equal at the threshold; what shares a band of four places only doesn't meet."""
    assert (S.parts_of(0.85), S.parts_of(0.8), S.parts_of(0.5), S.parts_of(1.0), S.parts_of(1.1)) == (20, 26, BANDS, 1, 1)
    rng = np.random.default_rng(4)
    base = np.arange(PERMUTATIONS)
    rows = [(0, base.tolist())]
    for k in range(1, 40):  # as unlike as the threshold allows: a place in each of nineteen parts, as it happens
        x = base.copy()
        x[rng.choice(PERMUTATIONS, 19, replace=False)] = -k
        rows.append((k, x.tolist()))
    for k in range(40, 60):  # one band of the base, else nothing
        rows.append((k, [v if 4 <= i < 8 else -k * 1000 - i for i, v in enumerate(base.tolist())]))
    parts = {r["n"]: set(r["p"]) for r in spark.createDataFrame(rows, "n long, signature array<long>").select("n", S.bands_of(parts=S.parts_of(S.THRESHOLD)).alias("p")).collect()}
    assert all(parts[0] & parts[k] for k in range(1, 40)) and not any(parts[0] & parts[k] for k in range(40, 60))
