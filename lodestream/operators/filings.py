"""Filings: adoption of a theme, divergence from its narrative, section alignment."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values
SECTION_WEIGHTS = {
    "management's discussion and analysis": 1.0,
    "risk factors": 0.9,
    "business": 0.8,
    "quantitative and qualitative disclosures about market risk": 0.7,
    "financial statements and supplementary data": 0.6,
    "properties": 0.3,
    "legal proceedings": 0.3,
}
OTHER_SECTION, SATURATION = 0.4, 20.0
COVERAGE, DEPTH, FACTS, TEMPORAL = 0.35, 0.25, 0.20, 0.20
STRONG_NARRATIVE, VERY_STRONG_NARRATIVE, WEAK_NARRATIVE = 50.0, 70.0, 20.0
WEAK_ADOPTION, VERY_WEAK_ADOPTION, STRONG_ADOPTION = 0.2, 0.1, 0.6


def section_weight(name: Column) -> Column:
    """By the whole name, else by the first known name in it."""
    low = F.lower(F.trim(name))
    inside, exact = F.lit(OTHER_SECTION), F.lit(None).cast("double")
    for k, v in reversed(SECTION_WEIGHTS.items()):
        inside = F.when(low.contains(k), F.lit(v)).otherwise(inside)
        exact = F.when(low == k, F.lit(v)).otherwise(exact)
    return F.coalesce(exact, inside)


def adoption(sections: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Adoption by key: coverage, depth, fact alignment, temporal consistency and their weighted sum.

    sections: key, period, section, word_count, mentions; facts: key, concepts, matched.
    A section without words gives no signal but counts in the coverage's denominator.
    """
    w = section_weight(F.col("section"))
    signal = (F.col("word_count") > 0) & (F.col("mentions") > 0)
    density = F.when(signal, F.col("mentions") * 1000.0 / F.col("word_count"))
    rows = sections.withColumns({"_w": w, "_on": signal, "_depth": F.when(signal, F.least(F.lit(1.0), density / SATURATION) * w)})
    out = rows.groupBy(*key).agg(
        (F.sum(F.when(F.col("_on"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("coverage"), F.coalesce(F.avg("_depth"), F.lit(0.0)).alias("depth"),
        (F.countDistinct(F.when(F.col("_on"), F.col("period"))) / F.countDistinct("period")).alias("temporal"), F.countDistinct("period").alias("periods"),
    )
    out = out.join(facts, key, "left").withColumn("fact_alignment", F.when(F.coalesce(F.col("concepts"), F.lit(0)) > 0, F.col("matched") / F.col("concepts")).otherwise(0.0))
    return out.withColumn("adoption", COVERAGE * F.col("coverage") + DEPTH * F.col("depth") + FACTS * F.col("fact_alignment") + TEMPORAL * F.col("temporal")).drop("concepts", "matched")


def divergence(adopted: DataFrame, key: list[str]) -> DataFrame:
    """One row for each rule that fires: lagging adoption (in its place no hype risk), hype risk, under-appreciated."""
    strong, weak = F.col("narrative") >= STRONG_NARRATIVE, F.col("adoption") < WEAK_ADOPTION
    lagging = strong & weak & F.col("temporal").between(0.3, 0.7) & (F.col("periods") >= 2)
    severity = F.when((F.col("narrative") >= VERY_STRONG_NARRATIVE) & (F.col("adoption") < VERY_WEAK_ADOPTION), "critical").otherwise("warning")
    rules = [(lagging, "lagging_adoption", F.lit("info")), (strong & weak & ~lagging, "narrative_without_filing", severity), ((F.col("narrative") < WEAK_NARRATIVE) & (F.col("adoption") >= STRONG_ADOPTION), "filing_without_narrative", F.lit("info"))]
    fired = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("reason"), level.alias("severity"))) for rule, name, level in rules]))
    return adopted.withColumn("_f", fired).select(*key, F.inline("_f"))


def aligned(base: DataFrame, target: DataFrame, pair: str, least: float = 0.6) -> DataFrame:
    """(pair, base, target, similarity): one-to-one matches of the sections of two filings, best first; the rest unmatched.

    A pair's sections are few, so a group is bounded by the size of a filing's table of contents.
    """
    schema = "pair string, base string, target string, similarity double"

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = (sorted(x["name"]) if len(x) else [] for x in (a, b))
        scored = sorted(((difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), x, y) for x in left for y in right), key=lambda s: (-s[0], s[1], s[2]))
        out, used_a, used_b = [], set(), set()
        for s, x, y in scored:
            if s >= least and x not in used_a and y not in used_b:
                out.append((key[0], x, y, s))
                used_a.add(x)
                used_b.add(y)
        out += [(key[0], x, None, None) for x in left if x not in used_a] + [(key[0], None, y, None) for y in right if y not in used_b]
        return pd.DataFrame(out, columns=["pair", "base", "target", "similarity"])

    one = lambda rows: rows.select(F.col(pair).cast("string").alias("pair"), F.col("name").alias("name")).distinct().groupBy("pair")
    return one(base).cogroup(one(target)).applyInPandas(match, schema)


def section_diff(base: Column, target: Column) -> Column:
    """struct(changed, added_lines, removed_lines, ratio) of two texts by their lines: what a line differ tells of matched blocks."""

    @F.pandas_udf("struct<changed boolean, added_lines int, removed_lines int, ratio double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            m = difflib.SequenceMatcher(None, x.splitlines(), y.splitlines())
            moves = [o for o in m.get_opcodes() if o[0] != "equal"]
            out.append((x != y, sum(j2 - j1 for *_, j1, j2 in moves), sum(i2 - i1 for _, i1, i2, *_ in moves), m.ratio()))
        return pd.DataFrame(out, columns=["changed", "added_lines", "removed_lines", "ratio"])

    return run(base, target)
