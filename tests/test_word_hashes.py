"""Hashes of runs of words against Spark's own, and groups that batches cut."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.functions.word_hashes import run_hashes
from lodestream.operators import vectors as V


def test_runs_of_words_have_sparks_hashes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé価😀.") for _ in range(rng.choice([1, 2, 5, 9, 40])))
    texts = [rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\r\n"]).join(word() for _ in range(rng.randrange(0, 14))) + rng.choice(["", "\n"]) for _ in range(120)] + ["", " \n", "one", "a\x0bb c d"]
    values, bounds = run_hashes(pa.array(["cut off", *texts]).slice(1), 5)
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, text string").select("n", T.words(F.col("text")).alias("w"))
    want = {r["n"]: r["h"] for r in frame.filter("size(w) > 0").select("n", shingle.alias("h")).collect()}
    assert {n: values[bounds[n] : bounds[n + 1]].view(np.int64).tolist() for n in range(len(texts)) if bounds[n + 1] > bounds[n]} == want and len(want) > 80


def test_groups_go_on_over_batches():
    keys = [0, 0, 1, 1, 1, 1, 2, 3, 3]
    batch = pa.RecordBatch.from_pydict({"g1": keys, "g2": [0] * 9, "g3": [0] * 9, "node": list(range(9))})
    for size in (1, 2, 4, 9):
        found = [g.column("node").to_pylist() for g in V._groups(batch.slice(k, size) for k in range(0, 9, size))]
        assert found == [[0, 1], [2, 3, 4, 5], [6], [7, 8]]
    assert not list(V._groups([])) and not list(V._groups([batch.slice(0, 0)]))
