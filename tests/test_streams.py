"""Sinks and state machines of streams: replays, restarts, and the same rules one by one."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.streaming import pipeline, quarantine, runs

BEGIN = dt.datetime(2026, 3, 1)


def judge(df):
    """Even numbers are good; multiples of three become good at the second try."""
    ok = (F.col("n") % 2 == 0) | ((F.col("n") % 3 == 0) & (F.col("tries") >= 1))
    return df.withColumns({"error": F.when(F.coalesce(~ok, F.lit(True)), "odd"), "twice": F.col("n") * 2})


def contents(spark, sink):
    out = {k: sorted((r["n"] if r["n"] is not None else -1, r["tries"]) for r in sink.read(spark, k).collect()) for k in ("good", "dead")}
    return out["good"], out["dead"]


def expected(numbers):
    good = [(n, 1) for n in numbers if n is not None and n % 2 == 0] + [(n, 2) for n in numbers if n is not None and n % 2 and n % 3 == 0]
    return sorted(good), sorted((-1 if n is None else n, 3) for n in numbers if n is None or (n % 2 and n % 3))


def test_a_replay_after_half_a_write_leaves_each_row_once(spark, tmp_path):
    sink = quarantine.Quarantine(f"file://{tmp_path}/q", judge)
    frame = lambda a, b: spark.createDataFrame([(n,) for n in [*range(a, b), None]], "n long")
    sink(frame(0, 10), 0)
    spark.createDataFrame([(12, 24, 1)], "n long, twice long, tries int").write.parquet(f"file://{tmp_path}/q/good/epoch=1")  # what a lost driver left
    sink(frame(10, 20), 1)
    sink(frame(10, 20), 1)
    assert sink.drain(spark, 1) == 3
    assert contents(spark, sink) == expected([*range(20), None, None])
    assert sink.read(spark, "dead").first()["error"] == "odd" and "twice" in sink.read(spark, "good").columns


def test_a_stream_that_fails_between_writes_goes_on_from_its_checkpoint(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(n,) for n in range(10 * k, 10 * k + 10)], "n long").coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")
    sink = quarantine.Quarantine(f"file://{tmp_path}/out", judge)
    fail = [True]

    def half(batch, epoch):
        if epoch == 1 and fail[0]:
            fail[0] = False
            batch.withColumns({"twice": F.lit(0).cast("long"), "tries": F.lit(1)}).write.parquet(f"file://{tmp_path}/out/good/epoch=1")
            raise RuntimeError("lost")
        sink(batch, epoch)

    def go():
        source = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        source.writeStream.foreachBatch(half).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    sink.drain(spark, 2)
    assert contents(spark, sink) == expected(range(30))


def run_rows():
    rng = np.random.default_rng(3)
    centres = np.eye(4)
    at, rows = 0.0, []
    for k in range(120):
        at += float(rng.choice([1, 20, 90, 200, 1500], p=[0.4, 0.3, 0.2, 0.07, 0.03]))
        rows.append((int(rng.integers(0, 2)), k, BEGIN + dt.timedelta(minutes=at), (centres[rng.integers(0, 4)] + rng.normal(size=4) * 0.2).tolist()))
    return rows


def one_by_one(rows):
    """Begun and joined, with the run of each document."""
    open_, number, out = {0: {}, 1: {}}, {0: 0, 1: 0}, []
    for theme, doc, at, v in rows:
        now, v, mine = at.replace(tzinfo=dt.UTC).timestamp(), np.asarray(np.float32(v), float), open_[theme]
        best, chosen = runs.SIMILAR, None
        for k in sorted(mine, key=lambda k: (-mine[k][1], k))[: runs.RECENT]:
            c, last, _ = mine[k]
            s = float(c @ v / np.linalg.norm(c) / np.linalg.norm(v))
            if now - last <= runs.CLOSING * 3600 and (s > best or (s == best and chosen is None)):
                best, chosen = s, k
        for k in [k for k, (_, last, _) in mine.items() if now - last > runs.CLOSING * 3600]:
            del mine[k]
        if chosen is None:
            chosen, number[theme] = number[theme], number[theme] + 1
            mine[chosen] = (v, now, 1)
            out.append((theme, doc, chosen, 1, "begun"))
        else:
            c, last, n = mine[chosen]
            mine[chosen] = (0.8 * c + 0.2 * v, now, n + 1)
            out.append((theme, doc, chosen, n + 1, "joined"))
    return sorted(out)


def test_runs_of_a_stream_are_those_one_by_one_also_after_a_restart(spark, tmp_path):
    before = spark.conf.get(runs.STATE_STORE[0])
    spark.conf.set(*runs.STATE_STORE)
    try:
        rows = run_rows()
        for k in range(0, 120, 40):
            spark.createDataFrame(rows[k : k + 40], "theme_id long, doc_id long, at timestamp, embedding array<float>").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            source = pipeline.stream(spark, f"file://{tmp_path}/in", 1)
            # each round is a restart from the checkpoint
            runs.narrative_runs(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"file://{tmp_path}/out").collect()
    finally:
        spark.conf.set(runs.STATE_STORE[0], before)
    assert sorted((r["theme_id"], r["doc_id"], r["run"], r["doc_count"], r["what"]) for r in out if r["doc_id"] is not None) == one_by_one(rows)
    aged = [r for r in out if r["doc_id"] is None]
    assert aged and {r["status"] for r in aged} == {"cooling", "closed"} and len({(r["theme_id"], r["run"], r["status"], r["at"]) for r in aged}) == len(aged)
