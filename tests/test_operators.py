"""Operators on small literal rows."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import scoring as S, text as T
from lodestream.operators import backtest as B, claims as C, documents as D, factors as A, graph as G, market as M, themes as H, vectors as V
from lodestream.sources import documents as SD, files as SF

from .conftest import SF as SMALL


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_quantity_units(spark):
    cases = {"$42 billion": (42e9, "USD"), "36%": (36.0, "%"), "3nm": (3.0, "nm"), "8 weeks": (8.0, "weeks"), "5 million": (5e6, "count"), "1,200 units": (1200.0, "count"), "next quarter": None, "": None}
    for raw, want in cases.items():
        got = one(spark, T.quantity(F.lit(raw)))
        assert (got and tuple(got)) == want, raw


def test_numbers(spark):
    assert [one(spark, T.number(F.lit(x))) for x in ("(1,234.5)", "$12", " 7% ", ".", "N/A", "x")] == [-1234.5, 12.0, 7.0, None, None, None]


def test_periods_and_forms(spark):
    assert [one(spark, T.period_of(F.lit(x), F.lit(2025))) for x in ("Q3 2024", "second quarter", "H1 2026", "by 2027", "soon")] == ["2024-Q3", "2025-Q2", "2026-H1", "2027", None]
    assert [one(spark, T.filing_type(F.lit(x))) for x in ("10-k", " 10K/A", "form 4", "8-K", "10-K405", "SC 13D/A", "13F")] == ["10-K", "10-K", "4", "8-K", "8-K", "SC 13D", "13F-HR"]


def test_cashtags_and_modality(spark):
    assert one(spark, T.cashtags(F.lit("buy $nvda and $AMD, $nvda $toolong"))) == ["AMD", "NVDA"]
    assert one(spark, T.modality(F.lit("reportedly will expand"))) == "rumor"
    assert one(spark, T.modality(F.lit("company plans to build"))) == "guided"


def test_spam(spark):
    score = lambda text: one(spark, T.spam_score(F.lit(text), F.lit(0), F.lit("bob"), F.lit(5), F.lit(6), F.lit(True)))
    assert round(score("🚀🚀🚀🚀 join my discord for free signals"), 4) == 1.0
    assert round(score("a calm text about chips and their makers"), 4) == 0.5


def test_ema_is_seeded_with_the_first(spark):
    assert one(spark, H.ema(F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0)]), 3)) == 2.75
    assert one(spark, H.ema(F.array(F.lit(3.0)), 7)) == 3.0


def test_ranking_drops_low_scores_and_gates_tier_one(spark):
    rows = spark.createDataFrame([("a", 5.0, 3.0, "mature"), ("b", 4.0, 0.0, "mature"), ("c", 0.05, 9.0, "mature")], "theme_id string, score double, volume_zscore double, stage string")
    got = {r["theme_id"]: (r["position"], r["tier"]) for r in H.rank_themes(rows.withColumn("day", F.lit(1)), ["day"]).collect()}
    assert got == {"a": (1, 1), "b": (2, 3)}


def test_factor_regimes(spark):
    rows = [("f", f"2024-0{k}-01", v) for k, v in enumerate((10.0, 10.05, 12.0, None, 5.0), 1)]
    df = spark.createDataFrame(rows, "factor_id string, observation_date string, value double")
    assert [r["regime"] for r in A.with_regime(df).orderBy("observation_date").collect()] == ["observed", "stable", "rising", "missing", "observed"]


def test_streak_breaks_at_gaps_but_not_weekends(spark):
    days = [("2024-01-04", "watch"), ("2024-01-05", "watch"), ("2024-01-08", "watch"), ("2024-01-10", "watch"), ("2024-01-11", "none"), ("2024-01-12", "extreme")]
    df = spark.createDataFrame([("s", d, lv) for d, lv in days], "symbol string, day string, level string").withColumn("day", F.to_date("day"))
    got = [(r["persistence"], r["reset_reason"]) for r in M.persistence(df, ["symbol"]).orderBy("day").collect()]
    assert got == [(1, None), (2, None), (3, None), (1, "gap"), (0, None), (1, None)]


def test_capped_z(spark):
    assert one(spark, M.capped_z(F.lit(9.0), F.lit(1.0), F.lit(1.0))) == 3.0
    assert one(spark, M.capped_z(F.lit(2.0), F.lit(1.0), F.lit(0.0))) == 3.0
    assert one(spark, M.capped_z(F.lit(1.0), F.lit(1.0), F.lit(0.0))) == 0.0


def test_drawdown_and_metrics(spark):
    r = [0.1, -0.2, 0.05, -0.1]
    df = spark.createDataFrame([("t", k, x) for k, x in enumerate(r)], "ticker string, date int, r double")
    wealth, top, least = 1.0, 0.0, 0.0
    for x in r:
        wealth *= 1 + x
        top = max(top, wealth)
        least = min(least, wealth / top - 1)
    assert math.isclose(B.max_drawdown(df, ["ticker"]).first()["max_drawdown"], least)
    m = B.return_metrics(df, ["ticker"], 1).first()
    assert math.isclose(m["cumulative_return"], wealth - 1) and math.isclose(m["profit_factor"], 0.15 / 0.3)


def test_assertion_without_supports_is_retracted(spark):
    rows = [("a", "supports", 0.9, 1.0, "x", "active"), ("a", "contradicts", 0.9, 1.0, "y", "active"), ("b", "supports", 0.9, 1.0, "x", "retracted"), ("b", "contradicts", 0.5, 1.0, "x", "active")]
    df = spark.createDataFrame(rows, "k string, link string, confidence double, weight double, source_type string, status string").withColumns({"published_at": F.lit(None).cast("timestamp"), "approved": F.lit(False)})
    got = {r["k"]: (round(r["confidence"], 6), r["status"]) for r in C.aggregated(df, F.lit("2024-01-01").cast("timestamp"), ["k"]).collect()}
    assert got == {"a": (round(0.9 * 0.5 / 3 * 0.5, 6), "disputed"), "b": (0.0, "retracted")}


def test_propagation_takes_the_first_arrival(spark):
    e = spark.createDataFrame([("a", "b", "depends_on", 1.0), ("a", "c", "competes_with", 1.0), ("b", "d", "drives", 1.0), ("c", "d", "depends_on", 1.0), ("d", "a", "depends_on", 1.0)], "source string, target string, relation string, confidence double")
    got = {r["node"]: (r["depth"], round(r["impact"], 6)) for r in G.propagated(e, spark.createDataFrame([("a", 1.0)], "seed string, delta double")).collect()}
    assert got == {"b": (1, 0.56), "c": (1, -0.21), "d": (2, 0.196)}


def test_upsert_keeps_what_is_not_overwritten(spark):
    old, new = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, name string, v int"), spark.createDataFrame([(2, "z", None), (3, "w", 3)], "id int, name string, v int")
    assert sorted(map(tuple, D.upserted(old, new, ["id"], ["v"]).collect())) == [(1, "x", 1), (2, "y", None), (3, "w", 3)]


def test_pipe_rejects_short_lines(spark):
    lines = ["Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market", "20240102|A|5|0|10|Q", "20240102|B|5", "20240102|C|1|0|0|Q", "2"]
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    rows, bad = SF.short_volume(df)
    assert [(r["symbol"], r["short_ratio"] and float(r["short_ratio"])) for r in rows.orderBy("line").collect()] == [("A", 0.5), ("C", None)]
    assert [r["line"] for r in bad.collect()] == [2]
    assert SF.trailer_count(df).first()["expected"] == 2


def test_bls_periods_and_tables(spark):
    assert [str(one(spark, SF.period_date(F.lit(2024), F.lit(x)))) for x in ("M03", "Q02", "M13")] == ["2024-03-01", "2024-04-01", "None"]
    df = spark.createDataFrame([('[["a","b"],["1","2"],["3","4"]]',)], "value string")
    assert sorted(map(tuple, SF.array_table(df).collect())) == [(1, "a", "1"), (1, "b", "2"), (2, "a", "3"), (2, "b", "4")]


def test_csv_preamble(spark):
    df = spark.createDataFrame(list(enumerate(["about", "Time Period,X", "2024-01,1.5", "2024-02,ND"])), "line long, value string")
    assert sorted((r["date"], r["value"]) for r in SF.csv_after_header(df).collect()) == [("2024-01", 1.5), ("2024-02", None)]


def test_posts_are_quarantined(spark):
    lines = ['{"id":"1","text":"imo $nvda up","created_at":"2024-01-02T03:04:05Z"}', '{"id":"2","text":" ","created_at":"2024-01-02T03:04:05Z"}', "no json"]
    good, bad = SD.posts(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["content"] for r in good.collect()] == ["in my opinion $nvda up"] and bad.count() == 2


def test_minhash_finds_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(f"v{rng.randrange(5000)}" for _ in range(400))), (5, None), (6, "")]
    got = {r["doc_id"]: r["class_id"] for r in V.minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("block", [3, 256])
def test_minhash_classes_against_brute_force(spark, monkeypatch, block):
    """Drifting families (A like B, B like C, A not like C) and a bucket of many documents: no link that the bands show is lost."""
    monkeypatch.setattr(V, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = []
    for family in range(4):
        text = [word() for _ in range(150)]
        for _ in range(12):
            rows.append((rng.randrange(10**6), " ".join(text)))
            text[rng.randrange(150)] = word()
    rows += [(10**7 + k, rows[0][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = {r["doc_id"]: r["signature"] for r in V.signatures(docs).collect()}
    of = {i: i for i in signed}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in itertools.combinations(signed, 2):
        x, y = signed[a], signed[b]
        if any(x[k : k + 4] == y[k : k + 4] for k in range(0, 128, 4)) and sum(p == q for p, q in zip(x, y, strict=True)) >= V.SIMILAR * 128:
            of[max(top(a), top(b))] = min(top(a), top(b))
    assert {r["doc_id"]: r["class_id"] for r in V.minhash_classes(docs).collect()} == {i: top(i) for i in signed}


def test_minhash_recall(spark):
    """Of the document pairs that are similar by 0.85 or more, nine in ten at least are in one class."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    of = {r["doc_id"]: r["class_id"] for r in V.minhash_classes(docs).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert len(pairs) > 5 and sum(of.get(a) == of.get(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_readiness_and_levels(spark):
    assert one(spark, S.level(F.lit(0.4), 0.3, 0.5)) == "warning"
    assert one(spark, S.readiness(F.lit("aging"), F.lit("healthy"), F.lit("clear"))) == "warn"
    assert one(spark, S.readiness(F.lit("unknown"), F.lit("unknown"), F.lit("clear"))) == "ready"
    assert one(spark, S.readiness(F.lit("fresh"), F.lit("healthy"), F.lit("quarantined"))) == "blocked"


def test_suppression_is_greedy(spark):
    rows = [("s", "t", f"2024-01-01 0{h}:00:00") for h in (0, 3, 5, 8, 9)]
    df = spark.createDataFrame(rows, "subject string, trigger string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["ts"].hour for r in H.suppressed_repeats(df).collect()) == [0, 5, 9]
