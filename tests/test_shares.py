"""What one task holds stays bounded: ranges, pieces, one reading."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from lodestream.functions import event_grammar as E
from lodestream.operators import backtest, entities, publish
from lodestream.plans import registry
from lodestream.sources import scratch

from .conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calibration_numbers_only_cells_that_an_edge_cuts(spark, monkeypatch):
    monkeypatch.setattr(backtest, "parts", lambda df: 7)
    rng = random.Random(3)
    rows = [(k, rng.randrange(4) / 4, float(i), i) for k in ("a", "b", None) for i in range({"a": 50, "b": 31, None: 17}[k])] + [("few", 0.1, 1.0, 1)]
    df = backtest.calibration(spark.createDataFrame(rows, "k string, s double, o double, i int"), "s", "o", 3, ["i"], ["k"])
    numbered = [x for x in plan_of(df).splitlines() if "row_number()" in x and "windowspecdefinition" in x]
    assert numbered and all("_cell" in x for x in numbered)
    want = []
    for k in ("a", "b", None):
        own = sorted((s, i, o) for key, s, o, i in rows if key == k)
        cut = [round(b * len(own) / 3) for b in range(4)]
        for b in range(3):
            part = own[cut[b] : cut[b + 1]]
            want.append((k, b, len(part), round(sum(p[0] for p in part) / len(part), 9), round(sum(p[2] for p in part) / len(part), 9)))
    got = [(r.k, r.bucket, r.n, round(r.mean_score, 9), round(r.mean_outcome, 9)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bundles_are_hashed_from_pieces_of_sorted_ranges(spark, monkeypatch):
    monkeypatch.setattr(publish, "PIECE", 100)
    rows = [(lane, i, f'{{"object_id":{i},"x":"é{i % 7}"}}') for lane in ("a", "b") for i in random.Random(1).sample(range(400), 400)]
    df = publish.bundle_checksum(spark.createDataFrame(rows, "lane string, object_id int, line string").repartition(5), "object_id")
    assert "rangepartitioning(lane" in plan_of(df)
    want = [(lane, "sha256:" + hashlib.sha256("\n".join(x for _, _, x in sorted(r for r in rows if r[0] == lane)).encode()).hexdigest(), 400) for lane in ("a", "b")]
    assert sorted(map(tuple, df.collect())) == want


def test_run_selection_is_dealt_once(spark):
    plan = plan_of(registry.QUERIES["run_selection"](spark, SF))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_parts_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART_BYTES", 4096)
    assert scratch.parts(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").filter("l_orderkey > 5")) >= 25
    assert scratch.parts(spark.range(3)) == 4


def test_events_are_dealt_out_and_rules_without_their_words_left_out(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Acme Corp raised prices by 5% in Q1 2026.")], "doc_id long, text string").coalesce(1)
    assert "REPARTITION_BY_NUM" in plan_of(entities.pattern_events(docs, set(), {}))
    tried, triggers = [], E.triggers
    monkeypatch.setattr(E, "triggers", lambda rule: tried.append(rule) or triggers(rule))
    assert [e.kind for e in E.events("Acme Corp raised prices by 5%. Nothing else.")] == ["price_change"]
    assert tried and all({"raised"} & E.heads(r) for r in tried)
    plain = [e for r in E.RULES for e in E.events("Aſh ſlips; Lead times have ſtretched, and Acme RAMPS UP output", (r,))]
    monkeypatch.setattr(E, "heads", lambda rule: frozenset(["lead", "acme", "nothing"]))
    assert plain == [e for r in E.RULES for e in E.events("Aſh ſlips; Lead times have ſtretched, and Acme RAMPS UP output", (r,))]


def test_filings_are_parsed_once(spark):
    plan = plan_of(registry.QUERIES["read_insider_transactions"](spark, SF).withColumn("one", F.lit(1)))
    assert plan.count("from_xml") + plan.count("xmltostructs") == 1, plan[:3000]
