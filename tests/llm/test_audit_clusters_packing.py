"""Filter audit, annulus clustering and best-two-fit packing: brute force, exact shares, odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestream.llm import best_fit_packing, centroid_clustering, filter_audit, textops

from .test_llm import SCHEMA, odd_rows

TOKENIZER = public_tokenizers.path(best_fit_packing.TOKENIZER)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def slice_of(*texts):
    return textops.text_buffers(pa.array(texts))


# words of one hash


def test_kinds_of_words_that_share_a_hash():
    data, off = slice_of("a bb a ccc bb a longer-than-eight longer-than-eighs longer-than-eight", "a a ccc")
    words = textops.Words(data, off)
    words.hash[:] = 7  # the worst hash there is
    order, new = words.kinds(by_row=False)
    kind = np.empty(len(order), int)
    kind[order] = np.cumsum(new)
    assert len({(words.bytes_of(w), kind[w]) for w in range(len(words))}) == len(set(kind)) == 5
    order, new = words.kinds(by_row=True)
    assert np.bincount(words.row[order[new]]).tolist() == [5, 2]


def test_equal_words_are_compared_to_their_last_byte():
    rng = random.Random(1)
    texts = [" ".join(w for k in range(60) for w in [rng.choice("ab") * rng.randrange(1, 40) + rng.choice("ab")])]
    words = textops.Words(*slice_of(*texts))
    a, b = (np.array(x) for x in zip(*itertools.product(range(len(words)), repeat=2), strict=True))
    assert words.equal(a, b).tolist() == [words.bytes_of(x) == words.bytes_of(y) for x, y in zip(a, b, strict=True)]


# filter audit


def masks_by_brute_force(rows, limits=filter_audit.Limits()):
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        fails = [len(w) < limits.words, 100 * len(set(w)) < limits.distinct * len(w), 100 * len(re.findall("[A-Z]", t)) > limits.capitals * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        out.append(fails)
    return out


def audit_by_brute_force(rows, labels):
    fails = masks_by_brute_force(rows)
    out = []
    for part in {r[3] or "" for r in rows}:
        mine = [k for k, r in enumerate(rows) if (r[3] or "") == part]
        total, part_rows = collections.Counter(), []
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone = [k for k in left if fails[k][f]]
                left_now = [k for k in left if not fails[k][f]]
                lost = [sum(any(lab[0] == rows[k][0] and lab[c] == 1 for lab in labels if lab[0] is not None) for k in gone) for c in (1, 2)]
                part_rows.append((f, (part, "".join("ABCDE"[x] for x in order), step + 1, len(left_now), len(gone), sum(fails[k][f] for k in mine if k not in left), sum(fails[k][f] and sum(fails[k]) == 1 for k in mine), *lost)))
                total[f] += len(gone)
                left = left_now
        out += [(*r, total[f]) for f, r in part_rows]
    return sorted(out)


def audited_rows():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(90)] + ["Big", "BIG", "#x", "é|"]
    long = [" ".join(rng.choice(vocabulary[:90] if rng.random() < 0.5 else vocabulary) for _ in range(rng.choice([5, 49, 50, 60, 150]))) for _ in range(40)]
    rows = odd_rows() + [(100 + k, rng.choice(long), "en", f"s{k % 3}", 1, 0, "", "", "", "") for k in range(70)]
    return [*rows, (101, long[0], "en", "s1", 1, 0, "", "", "", ""), (99, long[0], "en", "s2", 1, 0, "", "", "", ""), (None, long[0], "en", "", 1, 0, "", "", "", "")]


def test_audit_against_brute_force(spark):
    rows = audited_rows()
    labels = [(k, k % 2, 1 if k % 7 == 0 else None) for k in range(0, 140, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audit_by_brute_force(rows, labels)


def test_masks_of_long_texts_and_limits(monkeypatch):
    monkeypatch.setattr(filter_audit, "STRETCH", 7)  # counts over many stretches
    texts = ["Ab é#" * 50, "", "AAAA", None, "ß" * 99 + " x" * 300 + "|", "a b a b c"]
    limits = filter_audit.Limits(words=3, distinct=60)
    data, off = slice_of(*texts)
    got = filter_audit.masks(data, off, limits, filter_audit.byte_classes(limits.symbols))
    want = masks_by_brute_force([(None, t) for t in texts], limits)
    assert got.tolist() == [sum(int(f) << k for k, f in enumerate(w)) for w in want]


def test_shares_of_filters_add_up(spark, odd):
    """Over all orders a removed document is removed once, so the shares of a part add up to 120 times its documents that fail."""
    counts = filter_audit.mask_counts(odd, odd.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    failing = {r[0]: r[1] for r in counts.groupBy("part").agg(F.sum(F.when(F.col("mask") > 0, F.col("n")).otherwise(0))).collect()}
    shares = filter_audit.interactions(counts).filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley")).collect()
    assert {r[0]: r[1] for r in shares} == {p: 120 * n for p, n in failing.items()}


# annulus clustering


def clusters_by_brute_force(rows, dims, k, rounds, salt="2:"):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    return sorted(map(str, ((i, j, d, min(inertia[j], (1 << 63) - 1), min(sum(inertia.values()), (1 << 63) - 1), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)))


@pytest.mark.parametrize("spread,k,rounds", [(0.01, 7, 5), (0.5, 12, 3), (30_000.0, 9, 2), (1e9, 5, 1), (0.02, 300, 2), (0.3, 4, 0)])
def test_clusters_against_brute_force(spark, spread, k, rounds):
    rng = np.random.default_rng(int(k))
    v = (rng.normal(size=(180, 6)) * spread).astype(np.float32).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(i, v[3]) for i in range(200, 260)] + [(7, v[7]), (8, v[1]), (None, v[2]), (300, None), (301, v[0][:5]), (302, [*v[0], 1.0]), (303, [None, *v[0][1:]]), (304, [float("nan"), *v[0][1:]]), (305, [float("inf"), *v[0][1:]]), (306, []), (307, [0.0] * 6)]
    frame = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    got = centroid_clustering.cluster(frame, dims=6, k=k, rounds=rounds).drop("centroid")
    assert sorted(str(tuple(r)) for r in got.collect()) == clusters_by_brute_force(rows, 6, k, rounds)


def test_no_vectors_no_clusters(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert centroid_clustering.cluster(frame).count() == centroid_clustering.cluster(frame.limit(0)).count() == 0


def test_an_annulus_leaves_centroids_out_and_keeps_its_edge():
    c = np.array([[0, 0], [10, 0], [0, 10], [40, 0], [0, 90]], np.int64)
    a = centroid_clustering.Annulus(c)
    x = np.array([[5, 0], [0, 0], [41, 1], [0, 88], [5, 5]], np.int64)
    cluster, distance, compared = a.nearest(x)
    assert cluster.tolist() == [0, 0, 3, 4, 0] and distance.tolist() == [25, 0, 2, 4, 50]  # [5, 0] and [5, 5] lie on boundaries: ties
    assert compared < x.shape[0] * len(c)
    again, d2, fewer = a.nearest(x, cluster)
    assert again.tolist() == cluster.tolist() and d2.tolist() == distance.tolist() and fewer <= compared


# best-two-fit packing


def two_fit_one_by_one(lengths, capacity):
    """The rule on single documents, bin after bin."""
    left, bins = collections.Counter(lengths), []
    while left.total():
        bin_, gap = [], capacity
        while fits := [x for x in left if left[x] and x <= gap]:
            bin_.append(max(fits))
            left[bin_[-1]] -= 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            free = sorted(left.elements())
            pairs = [(free[i] + free[j], free[j], free[i]) for i in range(len(free)) for j in range(i + 1, len(free)) if bin_[-1] < free[i] + free[j] <= bin_[-1] + gap]
            if pairs:
                _, a, b = max(pairs)
                left[bin_.pop()] += 1
                bin_ += [a, b]
                left[a] -= 1
                left[b] -= 1
        bins.append(sorted(bin_, reverse=True))
    return bins


def test_patterns_against_the_rule_on_single_documents():
    rng = random.Random(8)
    for case in range(120):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randrange(1, capacity + 1) if case % 3 else rng.choice([capacity // 3 + 1, capacity // 2, 2, 3, capacity // 5 + 1]) for _ in range(rng.randrange(0, 70))]
        got = [b for b, n in best_fit_packing.best_two_fit(collections.Counter(lengths), capacity) for _ in range(n)]
        assert got == two_fit_one_by_one(lengths, capacity)
        assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in got)


def test_two_fit_beats_greedy():
    """Filled greedily, 6 + 3 leaves a gap of 1; in place of the 3 two documents of 2 fill it."""
    assert best_fit_packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_driver_work_depends_on_lengths_only():
    patterns = best_fit_packing.best_two_fit({k: 10**9 + k for k in range(1, 2049)}, 2048)
    held = sum(n for _, n in patterns)
    assert len(patterns) < 20_000 and held - 1 <= sum(k * (10**9 + k) for k in range(1, 2049)) / 2048 * 1.001


def verified(rows, pieces, capacity):
    """Pieces hold their documents' tokens once, in order, and sequences have no gaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text, *_, u, _h, _s, _n, _c in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, u, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, ((r["doc_id"], r["uid"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces))) == sorted(map(str, want))
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= capacity
    assert len(bins) == len(two_fit_one_by_one([w[4] for w in want], capacity))


@pytest.mark.parametrize("capacity", [16, 300, 2048])
def test_packing_of_odd_rows(spark, odd, capacity):
    out = best_fit_packing.pack(odd, ["doc_id", "uid", "source"], TOKENIZER, capacity=capacity)
    verified(odd_rows(), out.collect(), capacity)


def test_words_are_encoded_as_in_their_text(spark):
    texts = ["Don't  stop it's 3.14 x́ ́y ΟΔΟΣ Straße\u0085ﬁ", "<|endoftext|> a<|startoftext|>b", "日本語テキスト 한국어 \U0001f600\U0001f468‍\U0001f469", "é é\n가 ᅡ", "\t\n ", "''s 'S 'RE we'LL\x1c\x1f|x", "İstanbul I"]
    rows = [(k, t, None, None, None, k, "h", "s", "n", "c") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    verified(rows, best_fit_packing.pack(frame, ["doc_id", "uid"], TOKENIZER, capacity=8).collect(), 8)
    by_text = best_fit_packing.pack(frame, ["doc_id", "uid"], TOKENIZER, capacity=8, by_words=False)
    verified(rows, by_text.collect(), 8)


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(best_fit_packing, "REMEMBERED", 2)
    tokens = best_fit_packing.WordTokens(TOKENIZER)
    first = tokens(*slice_of("one two three", "two"), 0)
    again = tokens(*slice_of("one two three", "two"), 0)
    assert [x.tolist() for x in first] == [x.tolist() for x in again]


def test_new_operators_take_odd_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    labels = odd.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert filter_audit.audit(none, labels).count() == best_fit_packing.pack(none, ["doc_id"], TOKENIZER).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
    assert best_fit_packing.pack(odd.withColumnsRenamed({"hits": "offset", "score": "piece"}), ["doc_id", "offset", "piece"], TOKENIZER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
