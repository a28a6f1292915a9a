"""Overlapping entities against the rule on a frame of each document."""

from __future__ import annotations

import random

import pandas as pd

from lodestream.operators import entities as E


def _by_frame(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.assign(_l=frame["end"] - frame["start"]).sort_values(["start", "_l"], ascending=[True, False], kind="stable")
    kept: list[tuple] = []
    for e in frame.itertuples():
        over = [k for k in kept if e.start < k.end and k.start < e.end]
        if not over:
            kept.append(e)
            continue
        for k in over:
            if e.end - e.start > k.end - k.start and e.confidence >= k.confidence - 0.2 or e.confidence > k.confidence + 0.3:
                kept.remove(k)
                kept.append(e)
                break
    return [(k.doc_id, k.start, k.end) for k in frame.loc[[k.Index for k in kept]].drop_duplicates(["normalized", "type"]).itertuples()]


def test_overlaps_without_a_frame_for_each_document(spark):
    rng = random.Random(8)
    rows = []
    for d in range(300):
        spans = rng.sample([(a, a + n) for a in range(12) for n in range(1, 8)], rng.randrange(1, 9))
        rows += [(d, a, b, rng.choice([0.1, 0.3, 0.45, 0.7, 0.9]), rng.choice("ABCDEFGH"), rng.choice(["COMPANY", None])) for a, b in spans]
    schema = "doc_id long, start int, end int, confidence double, normalized string, type string"
    out = E.without_overlaps(spark.createDataFrame(rows, schema))
    want = [t for _, g in pd.DataFrame(rows, columns=["doc_id", "start", "end", "confidence", "normalized", "type"]).groupby("doc_id") for t in _by_frame(g)]
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in out.collect()) == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.createDataFrame([(1, None, 3, 0.5, "A", "X"), (1, 0, None, 0.5, "B", "X"), (1, 0, 3, None, "C", "X"), (None, 0, 3, 0.5, "A", "X"), (None, 1, 2, 0.9, "B", "X")], schema)
    assert sorted(str(r["doc_id"]) + r["normalized"] for r in E.without_overlaps(odd).collect()) == ["1A", "1B", "1C", "NoneB"]
