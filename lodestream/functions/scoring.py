"""Scores as column expressions: narrative components, freshness, authority, levels, readiness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from . import thesis_words as N


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def capped(c: Column, cap: float) -> Column:
    """c / cap, at most 1; null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), c / cap))


# Narrative components; fixed values: caps 60 an hour, 30, 50 documents, 5 platforms, 4 sources, 6 hours, 48 hours, decay .02 an hour
def attention(rate_per_hour: Column, acceleration: Column, docs: Column) -> Column:
    return 0.5 * clamp(rate_per_hour / 60.0) + 0.3 * clamp(acceleration / 30.0) + 0.2 * clamp(docs / 50.0)


def corroboration(platforms: Column, source_types: Column, spread_hours: Column) -> Column:
    """A spread that is unknown or 0 gives no speed."""
    speed = F.when(spread_hours > 0, clamp(1.0 - spread_hours / 6.0)).otherwise(0.0)
    return 0.4 * clamp(platforms / 5.0) + 0.35 * clamp(source_types / 4.0) + 0.25 * speed


def confirmation(sentiment: Column, authority: Column, high_share: Column) -> Column:
    return 0.45 * clamp(F.coalesce(authority, F.lit(0.0))) + 0.30 * clamp(F.abs(sentiment)) + 0.25 * clamp(high_share)


def novelty_persistence(quiet_hours: Column, age_hours: Column) -> Column:
    recency = F.exp(-0.02 * F.greatest(quiet_hours, F.lit(0.0)))
    lasting = clamp(F.log1p(F.greatest(age_hours, F.lit(0.0))) / F.log1p(F.lit(48.0)))
    return clamp(0.5 * recency + 0.25 * lasting + 0.25 * clamp(recency * (1 - 0.3 * lasting)))


def narrative_composite(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 100 * (0.30 * a + 0.25 * b + 0.25 * c + 0.20 * d)


def half_life_freshness(age_days: Column, half_life: float = 90.0) -> Column:
    """0.5 for what has no date, 1 for the future."""
    return F.when(age_days.isNull(), 0.5).otherwise(F.exp(-F.lit(0.6931471805599453) * F.greatest(age_days, F.lit(0.0)) / half_life))


def corroboration_factor(support: Column, contradiction: Column, diversity: Column, diversity_ceiling: float = 3.0, volume_ceiling: float = 5.0) -> Column:
    ratio = F.when(support + contradiction > 0, support / (support + contradiction)).otherwise(0.0)
    return ratio * capped(diversity, diversity_ceiling) * capped(support, volume_ceiling)


def author_score(correct: Column, total: Column, days_since_good: Column, account_days: Column, tier_weight: Column, followers: Column) -> Column:
    """Beta(2, 5) accuracy, recency, probation, tier and a follower bonus; fixed values .01, 30 days, cap .3 at a million."""
    recency = F.when(days_since_good.isNull(), 0.5).otherwise(F.exp(-0.01 * days_since_good))
    bonus = F.least(F.lit(0.3), 0.3 * F.log10(1 + F.coalesce(followers, F.lit(0))) / 6.0)
    return clamp(((correct + 2) / (total + 7) * recency * capped(account_days, 30.0) * tier_weight + bonus) / 10.3)


def level(value: Column, warning: float, critical: float, higher_is_worse: bool = True) -> Column:
    """ok, warning or critical."""
    if higher_is_worse:
        return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")
    return F.when(value < critical, "critical").when(value < warning, "warning").otherwise("ok")


def error_level(value: Column, warning: Column, critical: Column) -> Column:
    """ok, warning or critical of an error share: a threshold itself is still the better level."""
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("ok")


def readiness(freshness: Column, quality: Column, state: Column) -> Column:
    """blocked, warn or ready; what is unknown doesn't count against a lane."""
    return F.when((state == "quarantined") | (freshness == "stale") | (quality == "critical"), "blocked").when((freshness == "aging") | (quality == "degraded") | (state == "watch"), "warn").otherwise("ready")


def market_impact(conviction: Column, z: Column, acceleration: Column, platforms: Column, authority: Column, events: Column) -> Column:
    """Six capped terms, at most 100."""
    up = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    terms = [(up(conviction) * 0.55, 55.0), (up(z) * 12.0, 18.0), (up(acceleration) * 4.0, 12.0), (platforms * 3.0, 9.0), (up(authority) * 15.0, 12.0), (F.greatest(events, F.lit(0)) * 2.0, 8.0)]
    total = F.lit(0.0)
    for term, cap in terms:
        total = total + F.least(term, F.lit(cap))
    return F.least(total, F.lit(100.0))


# Fixed values of catalysts, authors and SEC facts
SIGNAL_BIAS = {"supply_increasing": "bullish", "product_momentum": "bullish", "supply_decreasing": "bearish", "product_risk": "bearish"}
SIGNAL_LABELS = {"supply_increasing": "expanding supply", "supply_decreasing": "tightening supply", "product_momentum": "product momentum", "product_risk": "product risk"}
RESEARCH_OUTLETS = ["semianalysis", "techinsights", "ic insights", "yole développement", "yole group", "trendforce", "counterpoint", "omdia", "gartner", "idc semiconductor"]


def market_bias(sentiment: Column, signal: Column) -> Column:
    """bullish, bearish or, where nothing speaks or both disagree, mixed."""
    s = F.coalesce(sentiment, F.lit(0.0))
    feel = F.when(s >= 0.08, "bullish").when(s <= -0.08, "bearish")
    told = F.lit(None).cast("string")
    for k, v in SIGNAL_BIAS.items():
        told = F.when(signal == k, v).otherwise(told)
    return F.when(told.isNotNull() & feel.isNotNull() & (told != feel), "mixed").otherwise(F.coalesce(told, feel, F.lit("mixed")))


def propagation_delta(sentiment: Column, bias: Column) -> Column:
    """The size of the sentiment between 0.15 and 0.35, signed by the bias, or else by itself."""
    s = F.coalesce(sentiment, F.lit(0.0))
    size = F.least(F.lit(0.35), F.greatest(F.lit(0.15), F.abs(s)))
    return F.when(bias == "bullish", size).when(bias == "bearish", -size).otherwise(size * F.signum(s))


def author_tier(name: Column, verified: Column, platform: Column) -> Column:
    low, sure = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.coalesce(verified, F.lit(False))
    outlet = F.lit(False)
    for x in RESEARCH_OUTLETS:
        outlet = outlet | low.contains(x)
    return F.when(outlet | (sure & platform.isin("substack", "news")), "research").when(sure, "verified").otherwise("anonymous")


def document_authority(verified: Column, followers: Column, engaged: Column, spam: Column, bonus: float = 0.2, most: float = 0.3, followers_at: float = 1e6, engaged_at: float = 1e4) -> Column:
    """Verified bonus, followers and engagement on log scales, and what spam leaves of the last fifth."""
    part = lambda c, at: F.when(c > 0, F.least(F.lit(most), most * F.log(c + 1) / F.log(F.lit(at + 1)))).otherwise(0.0)
    return clamp(F.when(verified, bonus).otherwise(0.0) + part(followers, followers_at) + part(engaged, engaged_at) + 0.2 * (1 - spam))


def fact_evidence(event_type: Column, delta: Column) -> Column:
    """Whether an official fact's change speaks for growth."""
    return F.when(event_type.isin("margin_compression", "restatement"), "contradictory").when(delta > 0, "corroborating").when(delta < 0, "contradictory").otherwise("neutral")


TELLING = {"authority": N.AUTHORITY, "evidence": N.EVIDENCE, "hype": N.HYPE, "risk": N.RISK, "action": N.ACTION, "technical": N.TECHNICAL}
#: As [\p{L}\p{N}_]+: word characters are letters, numbers and the low line.
WORDS = re.compile(r"\w+")


def telling_words(text: Column) -> Column:
    """struct(words, and how many of each list of telling words a text has): counted once a text, where an expression for each word is evaluated anew by every score that has it."""

    @F.pandas_udf("struct<words int, " + ", ".join(f"{k} int" for k in TELLING) + ">")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            low = [(x or "").lower() for x in texts]
            counts = {"words": [len(WORDS.findall(x)) for x in low]} | {k: [[w in x for w in v].count(True) for x in low] for k, v in TELLING.items()}
            yield pd.DataFrame(counts, dtype="int32")

    return run(text)


def thesis(text: Column, shortest: int = 50) -> Column:
    """struct(overall, authority, evidence, reasoning, risk, action, technical, flags) by the density of telling words; a text under ``shortest`` characters, or none, has no score."""
    told = telling_words(text)
    words = F.greatest(F.lit(1), told["words"]).cast("double")
    d = {k: told[k] / words for k in TELLING}
    ten = lambda c, scale=140.0: F.round(F.least(F.lit(10.0), c * scale), 2)
    parts = {k: ten(d[k]) for k in ("authority", "evidence", "risk", "action", "technical")} | {"reasoning": ten(d["evidence"] + d["risk"], 70.0)}
    mean = sum(parts.values(), F.lit(0.0)) / 6
    overall = F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), mean - F.least(F.lit(3.0), d["hype"] * 70.0))), 2)
    flags = F.array_compact(F.array(F.when(d["hype"] > 0.01, "hype_language"), F.when(d["evidence"] < 0.005, "no_evidence")))
    full = F.struct(overall.alias("overall"), *[c.alias(k) for k, c in parts.items()], flags.alias("flags"))
    none = F.struct(F.lit(0.0).alias("overall"), *[F.lit(0.0).alias(k) for k in parts], F.array(F.lit("too_short")).alias("flags"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < shortest, none).otherwise(full)


def thesis_text(description: Column, keywords: Column, tickers: Column, entities: Column, stage: Column, documents: Column) -> Column:
    """A theme as lines: description, up to 20 keywords, 10 tickers and 15 entities, stage and size."""
    line = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", ")))
    return F.concat_ws("\n", F.nullif(description, F.lit("")), line("Keywords: ", keywords, 20), line("Tickers: ", tickers, 10), line("Entities: ", entities, 15), F.concat(F.lit("Lifecycle: "), stage), F.concat(F.lit("Documents: "), documents.cast("string")))
