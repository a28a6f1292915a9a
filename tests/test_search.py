"""Keywords of documents and the text index against brute force."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pytest

from lodestream.operators import keywords, text_index


def odd_texts():
    rng = random.Random(3)
    vocabulary = ["chip", "fab", "the", "of", "wafer", "prices", "rose", "x", "2024", "Über", "CHIP", "--", "end.", "a,b"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 20, 200])))) for k in range(30)]
    return [*rows, (None, None), (None, "chip wafer chip"), (3, "chip of chip of the fab"), (50, ""), (51, "\t\n"), (52, "... !!!"), (53, "one"), (54, "chip " * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1.0) for i, t in odd_texts()], "doc_id long, text string, rank string, score double").repartition(3)


def keywords_by_brute_force(text, window, rounds, longest, shortest, limit):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
    place, seen = [], 0
    for t in tokens:
        seen += bool(re.match(r"[^\W_]", t))
        place.append(seen)
    able = [i for i, t in enumerate(tokens) if re.match(r"[^\W_]", t) and len(t) >= shortest and t not in keywords.STOP]
    weight = collections.Counter()
    for i, j in itertools.permutations(able, 2) if len(able) < 400 else ((i, j) for k, i in enumerate(able) for j in able[max(0, k - window) : k + window + 1]):
        if abs(place[i] - place[j]) < window and tokens[i] != tokens[j]:
            weight[tokens[i], tokens[j]] += 1
    nodes = sorted({tokens[i] for i in able})
    total = collections.Counter()
    for (a, _), n in weight.items():
        total[a] += n
    rank = dict.fromkeys(nodes, 1 / max(1, len(nodes)))
    for _ in range(rounds):
        rank = {b: 0.15 / len(nodes) + 0.85 * sum(n / total[a] * rank[a] for (a, c), n in weight.items() if c == b) for b in nodes}
    phrases, run = collections.Counter(), []
    for i in [*able, None]:
        if run and (i is None or i != run[-1] + 1):
            for at in range(0, len(run), longest):
                phrases[" ".join(tokens[j] for j in run[at : at + longest])] += 1
            run = []
        run.append(i)
    scored = sorted((-round(sum(rank[w] for w in p.split(" ")), 9), p, n) for p, n in phrases.items())[:limit]
    return [(k + 1, p, -s, n) for k, (s, p, n) in enumerate(scored)]


@pytest.mark.parametrize("window,rounds,longest", [(4, 20, 3), (2, 5, 1), (6, 50, 2)])
def test_keywords_against_brute_force(spark, docs, window, rounds, longest, monkeypatch):
    monkeypatch.setattr(keywords, "TOKENS", 300)  # many slices
    got = collections.defaultdict(list)
    for r in keywords.textrank(docs, window=window, rounds=rounds, longest=longest, limit=5).orderBy("rank").collect():
        got[r["doc_id"]].append((r["rank"], r["keyword"], r["score"], r["count"]))
    want = collections.defaultdict(list)
    for i, t in odd_texts():
        want[i] += keywords_by_brute_force(t, window, rounds, longest, 3, 5)
    for i in want.keys() | got.keys():
        assert len(got[i]) == len(want[i])
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[0] == b[0] and a[1] == b[1] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-6


def test_ranks_settle_at_page_rank():
    """Fixed rounds come close to the rank's own equation."""
    row, word = np.zeros(9, np.int64), np.array([0, 1, 2, 0, 3, 1, 4, 0, 2])
    _, _, rank, _ = keywords.ranked(row, word, np.arange(9), 3, 0.85, 100)
    again = keywords.ranked(row, word, np.arange(9), 3, 0.85, 101)[2]
    assert abs(rank - again).max() < 1e-6 and abs(rank.sum() - 1) < 1e-9


def cover_rank(text, terms):
    at = [(k, w) for k, w in enumerate((text or "").lower().split()) if w in terms]
    found = []
    for i, j in itertools.combinations_with_replacement(range(len(at)), 2):
        inside = [w for _, w in at[i : j + 1]]
        if set(inside) == set(terms) and set(inside[1:]) != set(terms) and set(inside[:-1]) != set(terms):
            found.append(0.1 / (1 + at[j][0] - at[i][0] - (j - i)))
    return sum(found)


@pytest.mark.parametrize("terms", [["chip"], ["chip", "fab"], ["the", "of", "chip"], ["chip", "nowhere"], [], ["CHIP", "chip"]])
def test_covers_against_brute_force(spark, docs, terms):
    index = text_index.build(docs, buckets=5)
    got = [(r["doc_id"], round(r["rank"], 9)) for r in text_index.cover_search(spark, index, terms, 1000).collect()]
    low = {t.lower() for t in terms}
    small = [(i, t) for i, t in odd_texts() if len((t or "").split()) < 1000]
    want = [(i, round(cover_rank(t, low), 9)) for i, t in small if low and low <= set((t or "").lower().split())]
    if low == {"chip"}:
        want.append((54, 500.0))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [r for _, r in got] == sorted((r for _, r in got), reverse=True)


def test_a_search_reads_postings_of_its_terms_only(spark, docs):
    index = text_index.build(docs, buckets=16)
    found = text_index.cover_search(spark, index, ["wafer"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters: [" in plan and "EqualTo(term,wafer)" in plan.replace(" ", "").replace("In(term,[wafer])", "EqualTo(term,wafer)")
    assert "documents" not in plan and len(index.occurrences(spark, ["wafer"])._jdf.queryExecution().optimizedPlan().toString()) > 0
    assert found.inputFiles() and all("/text-" in f for f in found.inputFiles())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert keywords.textrank(none).count() == 0
    index = text_index.build(none)
    assert text_index.cover_search(spark, index, ["chip"], 5).count() == text_index.bm25(spark, index, ["chip"]).count() == 0
    assert text_index.cover_search(spark, text_index.build(docs.filter("doc_id = 50")), ["chip"], 5).count() == 0
