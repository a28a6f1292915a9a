"""Edge cases of roll-ups, monitoring, stored rows and ownership filings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestream.operators import changes as C, monitoring as M, rollups as R
from lodestream.sources import ownership as O


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rollups_without_rows_or_weight(spark):
    shape = "run_id long, symbol string, n long, composite double, sentiment double"
    assert rows(R.symbol_rollups(spark.createDataFrame([], shape))) == []
    one = spark.createDataFrame([(1, "A", 0, None, 0.5), (2, "B", 2, -1.0, 0.5), (3, "B", 1, -2.0, None)], shape)
    assert rows(R.symbol_rollups(one)) == [("A", 1, 0, 0.0, 0.0), ("B", 2, 3, 0.0, 1.0 / 3)]


def test_theme_rollups_rank_ties_by_name(spark):
    runs = spark.createDataFrame([(1, 1, 2, 5.0, 1.0)], "theme_id long, run_id long, n long, composite double, sentiment double")
    names = spark.createDataFrame([(1, s, 1) for s in "gfedcba"], "theme_id long, symbol string, n long")
    assert rows(R.theme_rollups(runs, names)) == [(1, 1, 2, 5.0, 1.0, list("abcde"))]


def test_issuer_with_alerts_only(spark):
    scores = spark.createDataFrame([], "issuer string, theme string, score double")
    alerts = spark.createDataFrame([("i", "t", "critical"), ("i", None, None)], "issuer string, theme string, severity string")
    assert rows(R.issuer_summaries(scores, alerts)) == [("i", 1, 0.0, 0.0, 0.0, 2, 1, 0)]


def test_linked_events_repeat_and_null_tickers(spark):
    e = spark.createDataFrame([(1, ["A", "A", "B"]), (2, None), (3, [])], "event_id long, tickers array<string>")
    t = spark.createDataFrame([(7, ["B", "A"]), (8, None)], "theme_id long, tickers array<string>")
    assert rows(R.linked_events(e, t)) == [(1, 7)]


def test_distinct_events_keep_the_first_and_cap_confidence(spark):
    e = spark.createDataFrame([(k, f"2024-01-{k:02}", " Buy" if k % 2 else "buy", 0.9) for k in range(1, 9)] + [(9, None, "buy", 0.1), (9, None, None, None)], "doc_id long, created_at string, action string, confidence double")
    assert rows(R.distinct_events(e, ["action"])) == [(1, "2024-01-01", " Buy", 1.0, 9), (9, None, None, 0.7, 1)]


def test_signal_ties_go_to_supply(spark):
    e = spark.createDataFrame([(1, "capacity_expansion"), (1, "product_delay"), (2, "other"), (3, "product_delay")], "k long, event_type string")
    assert rows(R.investment_signals(e, "k").select("k", "signal")) == [(1, "supply_increasing"), (2, None), (3, "product_risk")]


def test_thresholds_are_the_better_level(spark):
    at = [(k, k <= 5) for k in range(1, 101)]
    df = spark.createDataFrame(at, "id long, bad boolean").withColumn("lane", F.lit("x"))
    found = M.ratio_checks(df, "lane", {"unresolved_entities": F.col("bad"), "lineage_completeness": ~F.col("bad")})
    assert rows(found.select("check", "severity")) == [("lineage_completeness", "ok"), ("unresolved_entities", "ok")]
    assert rows(M.worst(found.withColumn("severity", F.lit("warning")), "lane")) == [("x", "warning")]


def test_empty_lanes_and_metrics(spark):
    runs = spark.createDataFrame([], "lane string, completed_at timestamp")
    lanes = spark.createDataFrame([("filing",)], "lane string")
    assert rows(M.freshness_budgets(runs, lanes, F.lit("2024-01-01").cast("timestamp"))) == [("filing", 999.0, "critical")]
    base = spark.createDataFrame([("b", "m", 1.0), ("v", "k", 2.0)], "variant string, metric string, value double")
    assert rows(M.baseline_deltas(base, "b", ["v", "w"])) == [("v", "k", 2.0), ("v", "m", -1.0), ("w", "m", -1.0)]


def test_arrays_change_null_safely(spark):
    docs = spark.createDataFrame([(1, ["b"]), (2, None)], "id long, themes array<string>")
    new = spark.createDataFrame([(2, "z"), (2, "y"), (2, "z"), (1, None)], "id long, themes string")
    assert rows(C.with_added(docs, new, "id", "themes")) == [(1, ["b"]), (2, ["y", "z"])]
    ents = spark.createDataFrame([(1, None), (2, [("a", "x", 1)])], "id long, entities array<struct<type:string,normalized:string,n:int>>")
    assert [(r["id"], r["affected"], r["entities"] and tuple(r["entities"][0])) for r in C.merged_entity(ents, ("a", "x"), ("b", "y")).orderBy("id").collect()] == [(1, False, None), (2, True, ("b", "y", 1))]


def test_holdings_set_bad_filings_apart(spark):
    table = "<a:informationTable xmlns:a='u'><a:infoTable><a:nameOfIssuer>N</a:nameOfIssuer><a:cusip>ab1</a:cusip><a:value>1,0</a:value><a:shrsOrPrnAmt><a:sshPrnamt>x</a:sshPrnamt></a:shrsOrPrnAmt></a:infoTable></a:informationTable>"
    filings = spark.createDataFrame([("f", "d", table), ("g", "d", "<x/>"), ("h", "d", None), ("i", "d", "not xml")], "filer string, filed string, content string")
    good, bad = O.holdings(filings)
    assert [(r["filer"], r["cusip"], r["shares"], float(r["value"])) for r in good.collect()] == [("f", "AB1", None, 10.0)]
    assert sorted(r["filer"] for r in bad.collect()) == ["g", "h", "i"]


def test_event_theme_links_are_not_shuffled(spark):
    """Pairs come once, though they share several tickers and rows are repeated, and no exchange lies above the join."""
    rng = random.Random(6)
    some = lambda n: [(i % 30, rng.choices("abcdefg", k=rng.randrange(4)) + [None] * rng.randrange(2)) for i in range(n)]
    e, t = some(50) + [(99, None)], some(40)
    out = R.linked_events(spark.createDataFrame(e, "event_id long, tickers array<string>"), spark.createDataFrame(t, "theme_id long, tickers array<string>"))
    want = {(a, b) for a, x in e for b, y in t if {*(x or ())} & {*y} - {None}}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_event_theme_links_of_lists_and_shares(spark, monkeypatch):
    """Small lists and shares, null keys and null tickers give the pairs of brute force, each once."""
    monkeypatch.setattr(R, "LIST", 3)
    monkeypatch.setattr(R, "SHARE_PAIRS", 10)
    rng = random.Random(7)
    some = lambda n, m: [(rng.choice([*range(m), None]), rng.choice([None, ["a"], ["b", "a", "b"], ["c", None], rng.choices("abcdefg", k=2)])) for _ in range(n)]
    e, t = some(120, 90), some(60, 40)
    out = R.linked_events(spark.createDataFrame(e, "event_id long, tickers array<string>"), spark.createDataFrame(t, "theme_id string, tickers array<string>"))
    names = lambda rows: {k: {x for j, y in rows if j == k for x in y or () if x} for k, _ in rows}
    want = [(a, None if b is None else str(b)) for a, x in names(e).items() for b, y in names(t).items() if x & y]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) > 500


def test_event_theme_links_take_little_space(spark, tmp_path):
    """Pairs come in runs, so a file of them has a small part of the bytes that numbers of events and themes need."""
    rng = random.Random(8)
    e = [(i, ["all", f"t{rng.randrange(5)}", f"t{rng.randrange(5)}"]) for i in range(3000)]
    t = [(i, [f"t{i % 5}", f"t{i % 7}"]) for i in range(400)]
    out = R.linked_events(spark.createDataFrame(e, "event_id long, tickers array<string>"), spark.createDataFrame(t, "theme_id long, tickers array<string>"))
    out.coalesce(1).write.parquet(f"{tmp_path}/links")
    pairs = spark.read.parquet(f"{tmp_path}/links").count()
    size = sum(f.stat().st_size for f in tmp_path.glob("links/*.parquet"))
    assert pairs > 300_000 and size < pairs * 0.5
