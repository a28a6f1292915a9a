"""Words of any length teach the pieces of op9."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from lodestream.llm import lm_scoring


def expected(word: bytes, ids: dict, logp) -> collections.Counter:
    """How often each piece is expected in a word, by sums over its prefixes and suffixes."""
    n = len(word)
    arcs = [(s, e, i) for e in range(1, n + 1) for s in range(max(0, e - 25), e) if (i := ids.get(word[s:e])) is not None]
    before, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for s, e, i in arcs:
        before[e] = np.logaddexp(before[e], before[s] + logp[i])
    for s, e, i in reversed(arcs):
        behind[s] = np.logaddexp(behind[s], logp[i] + behind[e])
    out = collections.Counter()
    for s, e, i in arcs:
        out[i] += math.exp(before[s] + logp[i] + behind[e] - before[n])
    return out


@pytest.mark.parametrize("places", [1, 7, 1 << 16])
def test_long_words_are_expected_as_short_ones(monkeypatch, places):
    monkeypatch.setattr(lm_scoring, "PLACES", places)
    spelled, logp = lm_scoring.pieces(lm_scoring.VOCABULARY)
    lattice, ids = lm_scoring.Lattice(spelled, logp), {x: i for i, x in enumerate(spelled)}
    for word in (b"x", b"internationalisation,", "ñandú-weisung-".encode() * 9, b"q" * 41):
        got, want = lattice._expected_long(np.frombuffer(b" " + word, np.uint8)), expected(b" " + word, ids, logp)
        assert np.allclose(got, [want[i] for i in range(len(got))], rtol=1e-9, atol=1e-12)
        whole = lattice.expected(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        assert np.allclose(got, whole, rtol=1e-9, atol=1e-12)


def test_op9_learns_from_long_words(spark, tmp_path):
    texts = ["the nation " + "internationalisation" * k + " x" for k in range(1, 30)] + ["q" * 41, "é" * 300 + " the", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in lm_scoring.op9_lattice_lm(spark, str(tmp_path)).collect()}
    spelled, logp = lm_scoring.pieces(lm_scoring.VOCABULARY)
    ids = {x: i for i, x in enumerate(spelled)}
    tokens = {i: (x or "").encode().split() for i, x in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(t for i in train for t in tokens[i])
    n = sum(c.values()) + len(train)
    unseen = (sum(k == 1 for k in c.values()) + 1) / (n + 1)
    total = sum((expected(b" " + w, ids, logp) for w in c), collections.Counter())
    q = np.array([total[i] for i in range(len(spelled))]) + lm_scoring.LEAST
    lattice = lm_scoring.Lattice(spelled, np.append(np.log(q / q.sum() * (1 - np.exp(logp[-1]))), logp[-1]))
    one = lambda w: np.logaddexp(math.log((1 - unseen) * c[w] / n) if c[w] else -math.inf, math.log(unseen) + lattice._one(b" " + w)) / math.log(10)
    end = math.log10((1 - unseen) * len(train) / n + unseen * math.exp(logp[-1]))
    assert set(got) == set(tokens) and 0 < len(train) < len(tokens) and max(map(len, c)) > 500
    for i, ts in tokens.items():
        assert math.isclose(got[i]["score"], sum(map(one, ts)) + end, rel_tol=1e-5)


def test_count_words_spells_all_and_holds_little(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "TASK_BYTES", 2000)
    words = [f"{k:02d}" * 50 for k in range(60)] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array([w, f"{w} a"])], names=["text"]) for w in words]
    out = list(lm_scoring.count_words(batches, 3, None))
    assert len(out) > 1 and max(len(x) for b in out for x in b.column("spelled").to_pylist()) <= 2200
    counts, spellings = collections.Counter(), {}
    for b in out:
        for r in b.to_pylist():
            at = 0
            for key, n, size in zip(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["lengths"], np.int32), strict=True):
                counts[int(key)] += int(n)
                spellings[int(key)] = r["spelled"][at : at + size]
                at += size
    assert {spellings[k].decode(): n for k, n in counts.items()} == {w: 4 for w in set(words)} | {"a": 120, "": 240}
