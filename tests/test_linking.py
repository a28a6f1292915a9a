"""Edge cases of name resolution and linking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.operators import linking as L

ALIAS = "alias string, concept_id string, is_primary boolean, confidence double, review_status string, is_active boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("classes", "want"), [(["g06n 3/02"], "ai"), (["A01", "H04-L"], "net"), ([], None), (None, None), ([None, "G06N"], "ai")])
def test_class_prefix(spark, classes, want):
    df = spark.createDataFrame([(classes,)], "c array<string>")
    assert df.select(L.class_theme(F.col("c"), {"G06N": "ai", "H04L": "net"})).first()[0] == want


@pytest.mark.parametrize(("topics", "want"), [(["Deep Learning!"], "a"), (["learning"], "a"), (["chips"], None), ([None], None), (None, None)])
def test_topics_both_ways(spark, topics, want):
    df = spark.createDataFrame([(topics,)], "c array<string>")
    assert df.select(L.topic_theme(F.col("c"), {"deep-learning": "a"})).first()[0] == want


def test_candidates_order_rejected_and_limit(spark):
    many = [("Acme", f"c{k:02}", False, 0.5, "accepted", True) for k in range(12)]
    aliases = spark.createDataFrame([("ACME", "p", True, 0.1, "pending", True), ("acme", "x", True, 0.9, "rejected", True), ("acme", "y", True, 0.9, "accepted", False), *many], ALIAS)
    names = spark.createDataFrame([("Acme",), ("Acme",), (None,)], "name string")
    found = L.alias_candidates(names, aliases).orderBy("place").collect()
    assert [r["concept_id"] for r in found] == ["p", *[f"c{k:02}" for k in range(9)]]


def test_links_need_theme_and_security(spark):
    aliases = spark.createDataFrame([("acme", "c", True, 0.8, "pending", True)], ALIAS)
    sec = spark.createDataFrame([("c", "s")], "concept_id string, security_id string")
    shape = "record_id long, event_date string, event_type string, classes array<string>, assignees array<string>"
    patents = spark.createDataFrame([(1, "d", "grant", ["G06N"], ["ACME", "Other"]), (2, None, "grant", ["G06N"], ["ACME"]), (3, "d", "grant", ["X"], ["ACME"]), (4, "d", "grant", ["G06N"], None)], shape)
    assert rows(L.patent_links(patents, {"G06N": "ai"}, aliases, sec)) == [(1, "c", "s", "ai", 0.57)]
    assert rows(L.patent_links(patents, {"G06N": "ai"}, aliases, sec.limit(0))) == []


def test_identifier(spark):
    shape = "ticker string, exchange string, cik string, name string, issuer_name string, aliases array<string>, former_names array<string>, is_active boolean"
    s = spark.createDataFrame([("AB", "x", "0000000012", "Ab Co", None, None, ["Old Co"], True), ("OLD CO", "x", None, None, None, None, None, False), ("Z", "x", None, None, None, None, None, True)], shape)
    assert [(r["ticker"], r["priority"]) for r in L.resolved_identifier(s, " old co ", active_only=False).collect()] == [("OLD CO", 1), ("AB", 4)]
    assert [r["ticker"] for r in L.resolved_identifier(s, "CIK12").collect()] == ["AB"]
    assert L.resolved_identifier(s, "  ").count() == 0


def test_nothing_compared_proceeds(spark):
    none = spark.createDataFrame([], "severity string")
    assert rows(L.rollout_advice(none, spark.createDataFrame([(0,)], "n long"))) == [(0, 0, 0.0, "proceed")]


def test_structural_summary_of_nothing(spark):
    assert L.structural_summary(spark.createDataFrame([], "source string, target string, predicate string, is_current boolean")).count() in (0, 1)
