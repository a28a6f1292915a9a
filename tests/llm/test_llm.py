"""The training-data operators: SQL, brute force, round trips, held-out accuracy, odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontamination, jaccard_join, language_id, line_dedup, lm_scoring, packing, quality, queries, resharding, storage, substring_dedup, textops, toxicity
from lodestream.llm.components import components

from ..conftest import SF, same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, hits string, score string, n_words string, class string"
WORDS = [f"w{k}" for k in range(400)]


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    body = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    a, b = body(120), body(90)
    near = a.split()
    near[60] = "changed"
    texts = [a, a, " ".join(near), b + "\n" + a, None, "", " \t\n ", "x", "un deux", "é" * 3000, "run " * 300, "run " * 200 + b, "ab " * 150, body(9000), "solo\n" + a + "\n" + b, a + "\n\n" + b + "\nlast line", a + "\n\n" + b + "\nlast", "z" * 70_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, a), (None, None)]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"s{k}", None, k, "h", "s", "n", "c") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got, want = same_rows(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])
    assert got == want


def removed_by_brute_force(rows, window):
    count = collections.Counter(tuple(words(t)[k : k + window]) for _, t, *_ in rows for k in range(len(words(t)) - window + 1))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substrings_against_brute_force(spark, odd, window):
    rounds = {2: "", 5: "rp", 35: "rpppppp"}[window]
    got = substring_dedup.remove_repeats(spark, odd, ["doc_id"], window, rounds, digest=True)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, removed_by_brute_force(odd_rows(), window)))


def test_substrings_of_small_alphabets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") if k % 2 else rng.choice("aaab") for _ in range(rng.randrange(200)))) for k in range(60)]
    got = substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 12, "rppp", digest=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(removed_by_brute_force(rows, 12))


def shingle_set(text, k):
    w = lower(text).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_by_brute_force(rows, k, percent):
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[top(b)] = top(a)
    groups = collections.defaultdict(list)
    for x in range(len(rows)):
        groups[top(x)].append(rows[x][0])
    least = {g: min([i for i in ids if i is not None], default=None) for g, ids in groups.items()}
    return [(rows[x][0], len(sets[x]), least[top(x)]) for x in range(len(rows))]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 128), (5, 80, 128), (3, 60, 4)])
def test_jaccard_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(k)
    base = [[rng.choice(WORDS) for _ in range(rng.choice((3, 8, 40, 200)))] for _ in range(12)]
    rows = odd_rows()
    for n in range(100):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((100 + n, " ".join(w).replace("w1", "W1"), None, None, None, 0, "", "", "", ""))
    found = jaccard_join.with_least_id(jaccard_join.similar_components(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), ["doc_id"], k=k, percent=percent))
    got = found.select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, jaccard_by_brute_force(rows, k, percent)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (rng.randrange(500, 520), 530)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[200] == 100 and got[300] == 100


def test_lines_against_brute_force(spark, odd):
    rows = odd_rows()
    order = sorted(range(len(rows)), key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
    got = line_dedup.remove_repeated_lines(spark, odd.coalesce(1), ["doc_id"]).select("doc_id", "n_lines", "n_removed").collect()
    seen, want = set(), []
    for x in order:
        lines = [ln for ln in (rows[x][1] or "").split("\n") if ln.strip(" \t\n\r\x0b\x0c")]
        gone, mine = set(), []
        for k in range(len(lines) - 1):
            key = (lines[k], lines[k + 1])
            if key in seen:
                gone |= {k, k + 1}
            seen.add(key)
        want.append((rows[x][0], len(lines), len(gone)))
        del mine
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_single_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 7, 8, 9, 30, 60) for _ in range(4)] + [" " + " ".join(WORDS[:8]) + "  ", "ü " * 8]
    rows = [(k if k % 9 else None, "\n".join(rng.choice([*pool, "", f"own {k} {j}", " ".join(f"n{k}.{j}.{i}" for i in range(9))]) for j in range(rng.choice((1, 1, 2, 5, 12))))) for k in range(120)]
    rows += [(1000 + k, "a whole one-line text") for k in range(5)] + [(2000, "a whole one-line text\nand more"), (2001, "short"), (2002, None), (2003, "")]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    got = line_dedup.remove_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ["doc_id"], lone=8).collect()
    seen, want = set(), []
    for i, t in rows:
        lines = [(k, ln) for k, ln in enumerate((t or "").split("\n")) if ln.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for a, b in itertools.pairwise(lines):
            if (a[1], b[1]) in seen:
                gone |= {a[0], b[0]}
            seen.add((a[1], b[1]))
        for k, ln in lines:
            if len(ln.split()) >= 8 or len(lines) == 1:
                if (ln,) in seen:
                    gone.add(k)
                seen.add((ln,))
        want.append((i, len(lines), len(gone), None if t is None else "\n".join(ln for k, ln in enumerate(t.split("\n")) if k not in gone)))
    assert sorted(map(str, ((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got))) == sorted(map(str, want))


def test_pipeline_drops_copies_of_one_line(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(k, "one line", None, None, 8) for k in range(50)] + [(60, f"start\n{odd_rows()[0][1]}\nend", None, None, 1), (61, f"top\n{odd_rows()[0][1]}\nlast", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in P.fresh_lines(spark, docs, SF).collect()}
    assert sorted(kept) == [0, 60, 61] and kept[61] == "top\nlast"


def test_lines_keep_the_rest_of_the_text(spark):
    rows = [(1, "a a\nb b\nc c"), (2, "x\na a\nb b\n\ny"), (3, "a a\nb b"), (4, "a a\nq"), (5, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: "a a\nb b\nc c", 2: "x\n\ny", 3: "", 4: "a a\nq", 5: None}


def test_language_accuracy(spark):
    out = queries.QUERIES["op1_centroid_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count()


@pytest.mark.parametrize("n_long", [0, 1, 10])
def test_rejection_where_long_texts_are_few(spark, n_long):
    rng = random.Random(n_long)

    def text(letters, n):
        known = random.Random(letters)
        vocabulary = ["".join(known.choice(letters) for _ in range(known.randrange(2, 9))) for _ in range(150)]
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    a, b = "abcdefghijklm", "nopqrstuvwxyz"
    rows = [(k, text(a, rng.choice((60, 700))), "aa") for k in range(200)] + [(1000 + k, text(b, 60), "bb") for k in range(200)] + [(2000 + k, text(b, 700), "bb") for k in range(n_long)]
    rows += [(3000 + k, text("aeimquy", 700), "cc") for k in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [(k, text(b, 700)) for k in range(20)] + [(100 + k, " ".join("".join(rng.choice(b) for _ in range(6)) for _ in range(600))) for k in range(20)] + [(200 + k, text("aeimquy", 700)) for k in range(5)]
    out = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(new, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert {r["lang_pred"] for k, r in out.items() if k < 200} == {"bb"}
    assert {k for k, r in out.items() if r["rejected"]} == set(range(100, 120))


def test_toxicity_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    out = queries.QUERIES["op2_segment_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts.get((1, 0), 0)) and counts.get((0, 1), 0) <= 0.01 * counts[0, 0]


def test_segments_are_maximal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        at, gain = np.sort(rng.choice(30, n, replace=False)), rng.uniform(0.1, 2, n)
        score = np.full(30, -0.4)
        score[at] = gain
        best = max(score[i:j].sum() for i in range(30) for j in range(i + 1, 31))
        assert math.isclose(max(s for *_, s in toxicity.segments(at, gain, -0.4)), best)


def test_resharding(spark, odd):
    flow = resharding.min_cost_flow([10, 0, 5], [5, 5, 5], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert flow == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]
    out = queries.QUERIES["op7_flow_resharding"](spark, SF).toPandas()
    by = out.groupby("shard")
    assert len(by) == 8 and (by["slot"].max() + 1 == by["slot"].nunique()).all() and by["slot"].min().eq(0).all()
    assert by["size"].sum().max() - by["size"].sum().min() <= 2 * out["size"].max()
    small = resharding.reshard(odd, F.lit(0), 3, 1).collect()
    assert len(small) == len(odd_rows()) and {r["shard"] for r in small} <= {0, 1, 2}
    assert {r["text_crc32"] for r in small} >= {0, zlib.crc32(b"x")}


def test_rewrite_of_affected_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * (k + 1)) for k in range(40)], "doc_id long, text string")
    placed = resharding.reshard(docs, F.when(F.col("doc_id") < 30, 0).otherwise(1), 3, 2)
    resharding.rewrite_affected(docs, placed, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == 40


def test_rewrite_keeps_every_row_and_empties_old_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = [(None if k % 7 == 0 else k // 3, None if k == 14 else f"text {k} " * (k % 5 + 1), k % 4) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    docs = resharding.numbered(spark.read.parquet(path))
    resharding.rewrite_affected(docs.drop("shard"), resharding.reshard(docs, F.col("shard"), 2, 4), path)
    out = spark.read.parquet(path)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, (r[:2] for r in rows)))
    assert {r["shard"] for r in out.select("shard").collect()} == {0, 1} and out.select("shard", "slot").distinct().count() == 60


def test_rewrite_stops_where_rows_are_others(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string").coalesce(1)
    placed = resharding.reshard(docs, F.lit(0), 2, 1)
    with pytest.raises(Exception, match="number them first"):
        resharding.rewrite_affected(docs.orderBy(F.desc("doc_id")).coalesce(1), placed, path)


def test_quality_counts(spark, odd):
    got = {r["uid"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) for r in quality.score(odd, ["uid"]).collect()}
    for row in odd_rows():
        w = (row[1] or "").split()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert got[row[5]] == (len(w), sum(map(len, w)), 0, len(cover))


def test_quality_verdicts(spark):
    sf = SF.replace("0.001", "0.1")
    out = queries.QUERIES["op8_divergence_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    rate = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] >= 0.995 and rate[0] <= 0.4


def test_quality_of_a_rare_language(spark):
    rng = random.Random(8)

    def text(prefix, n=400):
        return " ".join(f"{prefix}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rng.choices(range(300), [1 / (k + 5) for k in range(300)], k=n))

    for often in (5, 40):  # no switch by size
        rows = [(k, text("e"), "en") for k in range(often)] + [(100 + k, text("x"), "xx") for k in range(3)] + [(200, text("q"), "en" if often == 40 else None), (300, text("y"), "yy"), (400, " ".join("abcdefghijklmnopqrst"[rng.randrange(20)] for _ in range(60)), "zz")]
        kept = {r["doc_id"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).filter("kept").collect()}
        assert kept == {r[0] for r in rows} - {200}


def test_lattice_sums_all_segmentations():
    spelled, logp = lm_scoring.pieces(lm_scoring.VOCABULARY)
    lattice = lm_scoring.Lattice(spelled, logp)

    def total(word, k=0):
        return 1.0 if k == len(word) else sum(math.exp(logp[lattice.ids[word[k:e]]]) * total(word, e) for e in range(k + 1, len(word) + 1) if word[k:e] in lattice.ids)

    some = [b"the", "é".encode(), b"nation", b"x9!"]
    ends = np.cumsum([len(x) for x in some])
    got = lattice.words(np.frombuffer(b"".join(some), np.uint8), ends - [len(x) for x in some], ends)
    for word, x in zip(some, got, strict=True):
        assert math.isclose(x, math.log(total(b" " + word)), rel_tol=1e-9) and math.isclose(x, lattice._one(b" " + word), rel_tol=1e-9)


@pytest.mark.parametrize("heavy", [4, 1 << 16])
def test_lm_counts(spark, odd, monkeypatch, heavy):
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    rows = odd_rows()
    train = odd.filter("uid % 2 = 0")
    got = {r["key"]: r for r in lm_scoring.score(spark, odd.select(F.col("uid").alias("key"), "text"), train, ["key"]).collect()}
    tokens = {r[5]: [*lower(r[1]).split(), "end"] for r in rows}
    c = collections.Counter(t for k, ts in tokens.items() if k % 2 == 0 for t in ts)
    n, v = sum(c.values()), len(c)
    for k, ts in tokens.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_learns_from_training_rows(spark):
    """Every score by brute force: an expectation step over the distinct training words, then counts and lattice mixed; held-out rows come close to the base."""
    rng = random.Random(9)
    stems, ends = ["ontion", "there", "weisung", "él", "ñande", "ing"], ["er", "ly", "s,", "ed."]
    texts = [" ".join(rng.choice(stems) + "".join(rng.choice(ends) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", None, "q" * 60 + " x"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    train = docs.filter("doc_id % 4 > 0")
    got = {r["doc_id"]: r for r in lm_scoring.score(spark, docs, train, ["doc_id"]).collect()}
    spelled, logp = lm_scoring.pieces(lm_scoring.VOCABULARY)
    ids = {x: i for i, x in enumerate(spelled)}

    def cuts(word, p, k=0):
        """(probability, pieces) of every segmentation, but for single bytes inside, whose share is next to nothing."""
        if k == len(word):
            yield 1.0, ()
        for e in range(k + 1, len(word) + 1):
            if (i := ids.get(word[k:e])) is not None and (p[i] > 1e-9 or not k):
                for x, some in cuts(word, p, e):
                    yield p[i] * x, (i, *some)

    tokens = {i: lower(x or "").split() for i, x in enumerate(texts)}
    c = collections.Counter(t for i, ts in tokens.items() if i % 4 for t in ts)
    n_docs = sum(i % 4 > 0 for i in tokens)
    n = sum(c.values()) + n_docs
    unseen = (sum(k == 1 for k in c.values()) + 1) / (n + 1)
    p, expected = np.exp(logp[:-1]), np.zeros(len(spelled))
    for w in c:
        if len(w) <= lm_scoring.LONG_WORD:
            found = list(cuts(b" " + w, p))
            for x, some in found:
                for i in some:
                    expected[i] += x / sum(y for y, _ in found)
    q = (expected + lm_scoring.LEAST) / (expected + lm_scoring.LEAST).sum() * (1 - math.exp(logp[-1]))
    lattice = lm_scoring.Lattice(spelled, np.append(np.log(q), logp[-1]))
    one = lambda w: math.log10((1 - unseen) * c[w] / n + unseen * math.exp(lattice._one(b" " + w)))
    end = math.log10((1 - unseen) * n_docs / n + unseen * math.exp(logp[-1]))
    for i, ts in tokens.items():
        assert math.isclose(got[i]["score"], sum(map(one, ts)) + end, rel_tol=1e-5)
    held = [r for i, r in got.items() if i % 4 == 0]
    assert sum(r["score"] for r in held) > 1.25 * sum(r["base_score"] for r in held)


def test_optimal_bounds():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(50), rng.randrange(1, 10)))
        counts, buckets = [rng.randrange(1, 9) for _ in lengths], rng.randrange(1, 5)
        cost = lambda bounds: sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
        assert cost(packing.optimal_bounds(np.array(lengths), np.array(counts), buckets)) == best


def test_packing(spark, odd):
    out = packing.pack(odd, ["doc_id"]).toPandas()
    assert len(out) == len(odd_rows())
    by = out.groupby(["bucket", "batch"])
    assert (by["slot"].max() + 1 == by["slot"].count()).all()
    assert ((by["slot"].count() * by["padded_length"].max() <= packing.BUDGET) | (by["slot"].count() == 1)).all() and (out["n_tokens"] <= out["padded_length"]).all()


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, odd_rows()[0][1]), (2, "X"), (3, None), (4, ""), (None, "un deux"), (2, "x")], "item_id long, text string")
    got = {r["uid"]: (r["n_hit"], list(r["items"])) for r in decontamination.scan(odd, items, ["uid"]).collect()}
    assert got[0] == (120, ["1"]) and got[7] == (1, ["2"]) and got[8] == (2, []) and got[4] == (0, []) and got[13][0] == 0


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(r[1].split()[:20])) for k, r in enumerate(odd_rows()) if r[1] and len(r[1].split()) > 20], "item_id long, text string")
    one = sorted(map(str, decontamination.scan(odd, items, ["uid"]).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    assert sorted(map(str, decontamination.scan(odd, items, ["uid"]).collect())) == one


def test_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünder --- A, b! C? the END")], "doc_id long, text string")
    r = decontamination.scan(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), ["doc_id"]).first()
    raw = b"\xc3\x9cnder --- A, b! C? the END"
    assert [raw[s["begin"] : s["end"]] for s in r["spans"]] == [b"A, b! C"]


def test_language_of_odd_rows(spark, odd):
    out = {r["uid"]: r for r in language_id.predict(odd, language_id.fit(odd), ["uid"]).collect()}
    assert out[4]["lang_pred"] == out[5]["lang_pred"] == out[6]["lang_pred"] == "und" and out[0]["lang_pred"] == "en" and len(out) == len(odd_rows())


@pytest.mark.parametrize("which", ["odd", "none"])
def test_every_operator_takes_odd_and_empty_tables(spark, odd, none, which):
    docs = odd if which == "odd" else none
    n = len(odd_rows()) if which == "odd" else 0
    labels = docs.select("doc_id", (F.col("uid") % 2).cast("int").alias("toxic"))
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    keep = ["doc_id", "source", "score", "n_words", "hits", "class", "uid"]
    results = [
        language_id.predict(docs, language_id.fit(docs), keep), toxicity.score(docs, toxicity.fit(docs, labels), keep), decontamination.scan(docs, items, keep), jaccard_join.similar_components(spark, docs, keep),
        line_dedup.remove_repeated_lines(spark, docs, keep), packing.pack(docs, keep), resharding.reshard(docs, F.lit(None).cast("int"), 8, 6), quality.score(docs, keep), lm_scoring.score(spark, docs, docs, keep), substring_dedup.remove_repeats(spark, docs, keep),
    ]
    assert [r.count() for r in results] == [n] * len(results)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs.count()
    for _, stage in P.STAGES[:-1]:
        docs = P.table(stage(spark, docs, SF))
        assert docs.columns == P.COLUMNS and 0 < docs.count() <= last
        last = docs.count()
    assert P.STAGES[-1][1](spark, docs, SF).count() == last == P.run(spark, SF).count()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    hits = decontamination.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), ["doc_id"]).filter("n_hit > 0").count()
    near = jaccard_join.similar_components(spark, docs, ["doc_id"], k=P.NEAR_K, percent=P.NEAR_PERCENT).filter("uid <> component_uid").count()
    assert hits == near == 0 and all(kept.values())


def test_rows_keep_their_numbers(spark, tmp_path):
    """The same rows have the same numbers by however many executors they are read, and equal results come of it."""
    path = f"file://{tmp_path}/docs with blanks"
    rows = [(k, f"text {k}", k % 3) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, uid int").repartition(6).write.parquet(path)
    found, results = [], []
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    for cores in (2, 12):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        docs = spark.read.parquet(path).filter("uid < 2")
        found.append({r["uid"]: r["text"] for r in storage.numbered(docs, ["text"]).collect()})
        results.append(sorted(map(str, substring_dedup.remove_repeats(spark, docs, ["doc_id"], 2, "").collect())))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert len(found[0]) == 2000 and found[0] == found[1] and results[0] == results[1]


def test_rows_of_other_inputs_are_written_once(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(50)], "doc_id long, text string").repartition(5)
    numbers = storage.numbered(docs, ["doc_id"])
    assert {(r["doc_id"], r["uid"]) for r in numbers.collect()} == {(r["doc_id"], r["uid"]) for r in numbers.collect()} and numbers.select("uid").distinct().count() == 50


def maximal(score, lo, hi):
    """All maximal segments by their definition: the best one, then those on both sides of it."""
    best = max(((score[i:j].sum(), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
    return maximal(score, lo, best[1]) + [best] + maximal(score, best[2], hi) if best[0] > 1e-12 else []


def test_all_segments_against_their_definition():
    rng = np.random.default_rng(7)
    for _ in range(100):
        n = int(rng.integers(1, 14))
        at, gain = np.sort(rng.choice(30, n, replace=False)), rng.uniform(0.02, 2, n)
        score = np.full(30, -0.4)
        score[at] = gain
        got = [(int(at[i]), int(at[j]) + 1, round(s, 9)) for i, j, s in toxicity.segments(at, gain, -0.4)]
        assert got == [(i, j, round(float(s), 9)) for s, i, j in maximal(score, 0, 30)]


def test_segments_take_linear_time():
    began = time.process_time()
    assert len(toxicity.segments(np.arange(200_000) * 40, np.full(200_000, 1.0), -0.05)) == 200_000
    assert time.process_time() - began < 2


def test_flow_costs_the_least():
    """Against every way to send whole units."""
    rng = random.Random(12)
    for _ in range(40):
        supply, capacity = [rng.randrange(4) for _ in range(2)], [rng.randrange(2, 6) for _ in range(3)]
        cost = [[rng.randrange(4) for _ in range(3)] for _ in range(2)]
        if sum(capacity) < sum(supply):
            continue
        splits = [[x for x in itertools.product(range(s + 1), repeat=3) if sum(x) == s] for s in supply]
        best = min(sum(c * x for row, xs in zip(cost, way, strict=True) for c, x in zip(row, xs, strict=True)) for way in itertools.product(*splits) if all(sum(xs[j] for xs in way) <= capacity[j] for j in range(3)))
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply and all(sum(x[j] for x in flow) <= capacity[j] for j in range(3))
        assert sum(c * x for row, xs in zip(cost, flow, strict=True) for c, x in zip(row, xs, strict=True)) == best


def test_quality_against_plain_counts(spark):
    """Symbols, repeated lines, failures and both divergences of written-out texts."""
    rng = random.Random(9)
    body = lambda n: " ".join(f"v{k}" for k in rng.choices(range(90), [1 / (k + 5) for k in range(90)], k=n))
    rows = [(k, body(120) + " $#" * (k % 3) + "\nsame line\nsame line" * (k % 2), "en") for k in range(30)] + [(100, "few words", "en"), (101, "a b c " * 40, "en"), (102, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    good = [r for r in rows if r[1] and r[0] < 100]
    count = collections.Counter(w for _, t, _ in good for w in t.split())
    total = sum(count.values())
    shares = sorted(c / total for c in count.values())[::-1][: quality.COMMON]
    assert np.allclose(sorted(refs[0][3][:-1])[::-1], shares) and refs[0][4][0] == len(good)
    out = {r["doc_id"]: r for r in quality.score(docs, ["doc_id"], refs).collect()}
    for k, t, _ in rows:
        r, w = out[k], (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = len({i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)})
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w)) and (r["kept"] is False or not r["base_failed"])
        if k < 100:
            known = [x for x, _ in count.most_common() if count[x] / total >= shares[-1]]
            if len(known) == quality.COMMON:
                own = collections.Counter(x if x in known else None for x in w)
                p, q = np.array([own[x] / len(w) for x in [*known, None]]), np.array([*(count[x] / total for x in known), 1 - sum(count[x] for x in known) / total])
                assert math.isclose(r["word_js"], float(quality.jensen_shannon(p[None], q)[0]), abs_tol=1e-9)


def test_long_texts_take_bounded_memory_to_hash():
    """A text of 30 MB: names of words as in small pieces."""
    text = (b"alpha beta Gamma \xc3\xa9t\xc3\xa9 " * 1_400_000)[:30_000_000]
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tracemalloc.start()
    w = textops.Words(data, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    small = textops.Words(data[:4000], np.array([0, 4000]))
    assert (w.hash[: len(small) - 1] == small.hash[:-1]).all() and (w.folded()[: len(small) - 1] == small.folded()[:-1]).all()
    assert peak < 20 * len(text)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, none, which):
    import corpus_pipeline as P

    docs = odd if which == "odd" else none
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert len(rows) <= (len(odd_rows()) if which == "odd" else 0), name
        if name != "packing":
            assert out.columns == P.COLUMNS
            kept = {(r["doc_id"], r["text"]) for r in rows}
            if which == "odd" and name != "language_id":
                assert (4, None) in kept or name == "near_duplicates" and any(t is None for _, t in kept)  # a null text has nothing to lose


def test_ids_that_are_no_numbers(spark):
    """Lines: the order of the input decides; languages and shards: any id."""
    rows = [("b", "same line of text\nand another one"), ("a", "same line of text\nand another one"), (None, "a third text")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_repeated_lines(spark, docs, ["doc_id"]).collect()}
    assert got == {"b": 0, "a": 2, None: 0}
    assert resharding.reshard(docs, F.lit(0), 2, 1).count() == 3 and packing.pack(docs, ["doc_id"]).count() == 3


def test_ties_of_languages_and_shards(spark):
    """Equal texts get one language and score; rows of equal size and text fill shards evenly."""
    docs = spark.createDataFrame([(k, "the same words again and again", "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    out = language_id.predict(docs, language_id.fit(docs), ["doc_id"])
    assert out.select("lang_pred", "score", "rejected").distinct().count() == 1
    shards = collections.Counter(r["shard"] for r in resharding.reshard(docs, F.lit(0), 4, 1).collect())
    assert sorted(shards.values()) == [10] * 4


def test_copies_do_not_reach_the_exchanges(spark, monkeypatch):
    """Texts that only their copies are like are linked by their sums: none of them is kept, exchanged or compared."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(3 * i + k, texts[i].upper() if k else texts[i]) for i in range(40) for k in range(3)]
    kept, write = {}, jaccard_join.table

    def watched(df):
        kept[",".join(df.columns)] = out = write(df)
        if "text" in df.columns:
            assert not out.count()
        return out

    monkeypatch.setattr(jaccard_join, "table", watched)
    found = jaccard_join.with_least_id(jaccard_join.similar_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])).select("doc_id", "n_shingles", "component_id").collect()
    assert "uid,text,known" in kept
    assert sorted(map(tuple, found)) == [(3 * i + k, 58, 3 * i) for i in range(40) for k in range(3)]
