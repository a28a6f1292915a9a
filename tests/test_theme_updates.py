"""Merging and finding themes, against the rules one by one."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from lodestream.operators import theme_updates
from lodestream.operators.keywords import STOP



def merges_one_by_one(pairs, n):
    n, gone, out = dict(n), set(), []
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in gone and b not in gone:
            keep, drop = (a, b) if n[a] >= n[b] else (b, a)
            n[keep] += n[drop]
            gone.add(drop)
            out.append((drop, keep, -s))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_merges_against_the_sequence(spark, seed):
    rng = random.Random(seed)
    themes = [(k, rng.choice([1, 2, 5, 5, 9])) for k in range(40)]
    pairs = [(a, b, rng.choice([0.85, 0.9, 0.9, 0.95])) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12]
    got = theme_updates.greedy_merges(spark.createDataFrame(pairs, "a long, b long, similarity double"), spark.createDataFrame(themes, "theme long, n long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(merges_one_by_one(pairs, themes))


def test_merged_themes_keep_weights_words_and_chains(spark):
    themes = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 1), (3, [0.0, 4.0], 4), (9, [5.0, 5.0], 2)], "theme long, centroid array<double>, n long")
    words = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.9), (2, "b", 0.1), (3, "c", 0.7), (9, "z", 0.2)], "theme long, word string, score double")
    merges = spark.createDataFrame([(2, 1, 0.9), (1, 3, 0.86)], "absorbed long, survivor long, similarity double")
    out = {r["theme"]: r for r in theme_updates.merged_themes(themes, words, merges, top=2).collect()}
    assert set(out) == {3, 9} and out[3]["n"] == 8 and out[3]["merged_from"] == [1, 2]
    assert np.allclose(out[3]["centroid"], [3 / 8, (1 + 16) / 8]) and [(w["word"], w["score"]) for w in out[3]["words"]] == [("a", 0.9), ("c", 0.7)]
    assert theme_updates.greedy_merges(spark.createDataFrame([], "a long, b long, similarity double"), themes.select("theme", "n")).count() == 0


def tfidf_by_brute_force(texts, top):
    docs = []
    for t in texts:
        w = [x for x in re.findall(r"\w{2,}", (t or "").lower()) if x not in STOP]
        docs.append(collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    df = collections.Counter(x for d in docs for x in d)
    total = collections.Counter()
    for d in docs:
        weight = {x: n * (math.log((1 + len(docs)) / (1 + df[x])) + 1) for x, n in d.items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        for x, v in weight.items():
            total[x] += v / norm
    return [x for _, x in sorted((-round(s, 9), x) for x, s in total.items())[:top]]


def test_tfidf_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Chip", "fab", "the", "wafer", "x", "price"]) for _ in range(rng.randrange(0, 9))) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "doc_id long, c int, text string")
    got = collections.defaultdict(list)
    for r in theme_updates.tfidf_keywords(docs, "c", "doc_id", top=6).orderBy("rank").collect():
        got[r["c"]].append(r["word"])
    assert got == {c: tfidf_by_brute_force(texts[c::2], 6) for c in (0, 1)}


def test_terms_are_counted_in_slices_and_spelled_without_a_list_too(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Chip", "fab", "the", "wafer", "naïve", "価格"]) for _ in range(rng.randrange(0, 30))) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "doc_id long, c int, text string").coalesce(1)
    monkeypatch.setattr(theme_updates, "TOKENS", 7)
    for most in (0, 200):
        monkeypatch.setattr(theme_updates, "MOST_SENT", most)
        got = collections.defaultdict(list)
        for r in theme_updates.tfidf_keywords(docs, "c", "doc_id", top=8).orderBy("rank").collect():
            got[r["c"]].append(r["word"])
        assert got == {c: tfidf_by_brute_force(texts[c::2], 8) for c in (0, 1)}
    # of two features the more frequent count, ties by the word
    least = theme_updates.tfidf_keywords(spark.createDataFrame([(1, 1, "bb zz bb aa"), (2, 1, "zz")], "doc_id long, c int, text string"), "c", "doc_id", features=2)
    assert {r["word"] for r in least.collect()} == {"bb", "zz"} and theme_updates.tfidf_keywords(docs.limit(0), "c", "doc_id").count() == 0


def test_second_batch_leaves_standing_themes_alone(spark):
    rng = np.random.default_rng(12)
    centre = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    v = (centre[np.arange(120) % 4] + rng.normal(size=(120, 12)) * 0.02).astype(np.float32)
    texts = [f"topic{i % 4} shares chip{i % 4}" for i in range(120)]
    rows = [(i, t, x.tolist()) for i, (t, x) in enumerate(zip(texts, v, strict=True))]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, embedding array<float>")
    none = spark.createDataFrame([], "theme_id string, centroid array<double>")
    size = {"k": 6, "probes": 9, "cells": 2, "least": 8}
    first, members = theme_updates.new_themes(frame([r for r in rows if r[0] < 60]), none, **size)
    standing = {r["theme_id"]: r for r in first.collect()}
    assert len(standing) == 4 and sum(r["members"] for r in standing.values()) == members.count() and all(len(r["name"]) > 3 for r in standing.values())
    other = (centre[5] + rng.normal(size=(40, 12)) * 0.02).astype(np.float32)
    batch = frame([r for r in rows if r[0] >= 60] + [(500 + i, "quantum leap", x.tolist()) for i, x in enumerate(other)] + [(None, "x", v[0].tolist()), (700, None, None)])
    found, joined = theme_updates.new_themes(batch, first.select("theme_id", "centroid"), **size)
    new = found.collect()
    assert len(new) == 1 and new[0]["members"] == 40 and new[0]["name"].startswith("leap") and {r["doc_id"] for r in joined.collect()} == set(range(500, 540))
    assert {r["theme_id"]: r["centroid"] for r in first.collect()} == {k: r["centroid"] for k, r in standing.items()}
    assert theme_updates.new_themes(batch.limit(0), none)[0].count() == 0
