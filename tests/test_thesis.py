"""Thesis scores count the telling words of a text once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestream.functions import scoring as S, thesis_words as N


def test_telling_words_are_counted_once(spark):
    texts = ["Revenue GROWTH of 5% — the analyst's report is a risk, however; TO THE MOON " * 2, "naïve Σ-test² of wafers_capacity, guaranteed pump " * 3, "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3).select("id", S.thesis(F.col("text")).alias("t")).select("id", "t.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan
    got = {r["id"]: r for r in df.collect()}
    for i, x in enumerate(texts[:2]):
        low, n = x.lower(), len(re.findall(r"\w+", x))
        d = {k: sum(w in low for w in v) / n for k, v in (("authority", N.AUTHORITY), ("evidence", N.EVIDENCE), ("hype", N.HYPE), ("risk", N.RISK), ("action", N.ACTION), ("technical", N.TECHNICAL))}
        for k in ("authority", "evidence", "risk", "action", "technical"):
            assert abs(got[i][k] - min(10, 140 * d[k])) < 0.00501
        assert abs(got[i]["reasoning"] - min(10, 70 * (d["evidence"] + d["risk"]))) < 0.00501
        assert got[i]["flags"] == [f for f, on in (("hype_language", d["hype"] > 0.01), ("no_evidence", d["evidence"] < 0.005)) if on]
    for i in (2, 3, 4):
        assert got[i]["flags"] == ["too_short"] and got[i]["evidence"] == 0
