"""Claims and assertions: aggregation, exposure, edges, numeric and polarity agreement, merges, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .themes import days_between

# Fixed values
HIGH_IMPACT = ["supplies_to", "customer_of", "competes_with", "acquires", "subsidiary_of", "parent_of"]
EVENT_PREDICATES = {
    "capacity_expansion": "expands_capacity", "capacity_constraint": "constrains_capacity", "product_launch": "launches_product",
    "product_delay": "delays_product", "price_change": "changes_pricing", "guidance_change": "revises_guidance",
}
VERBS = {
    "supplies_to": r"(?i)\b(?:suppl(?:y|ies|ied|ying)|provid(?:e|es|ed|ing)|manufactur(?:e|es|ed|ing)|fabricat(?:e|es|ed|ing)|produc(?:e|es|ed|ing))\b",
    "customer_of": r"(?i)\b(?:us(?:e|es|ed|ing)|adopt(?:s|ed|ing)?|purchas(?:e|es|ed|ing)|bu(?:y|ys|ying|ought)|order(?:s|ed|ing)?|sourc(?:e|es|ed|ing))\b",
    "competes_with": r"(?i)\b(?:compet(?:e|es|ed|ing)|rival(?:s|ed|ing)?|challeng(?:e|es|ed|ing)|undercut(?:s|ting)?|displac(?:e|es|ed|ing))\b",
    "depends_on": r"(?i)\b(?:partner(?:s|ed|ing)?|collaborat(?:e|es|ed|ing)|joint(?:ly)?|co-develop(?:s|ed|ing)?)\b",
}
NEAR, SURE_PAIR, UNCHANGED = 300, 0.45, 1e-6
DECAY, DIVERSITY, DISPUTED, EDGE_MIN, EXPOSURE_MIN, TOLERANCE = 0.01, 3.0, 0.6, 0.3, 0.1, 0.05


def aggregated(claims: DataFrame, at: Column, key: list[str], bonus: float = 0.1) -> DataFrame:
    """Assertions of key: confidence, status, support and contradiction counts, first and last sight.

    claims: key, link ('supports' or 'contradicts'), confidence, weight, source_type,
    published_at, status, approved.  Retracted claims don't count.
    """
    live = claims.filter("status <> 'retracted'")
    up, down = F.col("link") == "supports", F.col("link") == "contradicts"
    rows = live.groupBy(*key).agg(
        (F.sum(F.when(up, F.col("confidence") * F.col("weight"))) / F.sum(F.when(up, F.col("weight")))).alias("base"),
        F.count(F.when(up, 1)).alias("supports"),
        F.count(F.when(down, 1)).alias("contradictions"),
        F.countDistinct(F.when(up, F.col("source_type"))).alias("source_types"),
        F.max(F.when(up, F.col("published_at"))).alias("last_seen"),
        F.min(F.when(up, F.col("published_at"))).alias("first_seen"),
        F.max(F.coalesce(F.col("approved"), F.lit(False)).cast("int")).alias("_approved"),
    )
    fresh = F.when(F.col("last_seen").isNull(), 0.5).otherwise(F.exp(-DECAY * F.greatest(F.lit(0.0), F.floor(days_between(at, F.col("last_seen"))))))
    ratio = F.when(F.col("supports") + F.col("contradictions") > 0, F.col("supports") / (F.col("supports") + F.col("contradictions"))).otherwise(0.0)
    raw = F.coalesce(F.col("base"), F.lit(0.0)) * fresh * F.least(F.lit(1.0), F.col("source_types") / DIVERSITY) * ratio + F.when(F.col("_approved") == 1, bonus).otherwise(0.0)
    status = F.when(F.col("supports") == 0, "retracted").when((F.col("contradictions") > 0) & (ratio < DISPUTED), "disputed").otherwise("active")
    return rows.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).withColumn("status", status).drop("base", "_approved")


def exposures(assertions: DataFrame) -> DataFrame:
    """Per concept: assertions as subject and as object, by status, sum of active confidence, predicates."""
    rows = assertions.filter(F.col("confidence") >= EXPOSURE_MIN)
    one = lambda c, role: rows.select(F.col(c).alias("concept"), F.lit(role).alias("role"), "status", "confidence", "predicate")
    both = one("subject", "subject").unionByName(one("object", "object")).filter("concept is not null")
    return both.groupBy("concept").agg(
        F.count(F.when(F.col("role") == "subject", 1)).alias("as_subject"), F.count(F.when(F.col("role") == "object", 1)).alias("as_object"),
        F.count(F.when(F.col("status") == "active", 1)).alias("active"), F.count(F.when(F.col("status") == "disputed", 1)).alias("disputed"),
        F.sum(F.when(F.col("status") == "active", F.col("confidence")).otherwise(0.0)).alias("active_confidence"), F.array_sort(F.collect_set("predicate")).alias("predicates"),
    )


def derived_edges(assertions: DataFrame) -> DataFrame:
    """Adds edge: current, history, or null (a weak active assertion, or one without an object)."""
    strong = F.col("confidence") >= EDGE_MIN
    kind = F.when(F.col("object").isNull(), None).when(F.col("status").isin("retracted", "superseded"), "history").when(strong, "current").when(F.col("status") == "disputed", "history")
    return assertions.withColumn("edge", kind)


def numeric_links(claims: DataFrame, key: list[str]) -> DataFrame:
    """Each claim against its group's anchor (highest confidence, then time, then id) of one metric, unit and period.

    agree within 5 percent, contradict beyond, incomparable without a unit; nulls in the period are one group.
    """
    group = W.partitionBy(*key, "metric", "unit", "period")
    anchor = F.max(F.struct("confidence", "published_at", "claim_id", "value")).over(group)
    rows = claims.withColumn("_a", anchor)
    big = F.greatest(F.abs("value"), F.abs(F.col("_a.value")))
    kind = F.when(F.col("unit").isNull() | F.col("value").isNull(), "incomparable").when(F.col("claim_id") == F.col("_a.claim_id"), "anchor").when(big == 0, "agree").when(F.abs(F.col("value") - F.col("_a.value")) / big <= TOLERANCE, "agree").otherwise("contradict")
    return rows.withColumn("anchor_id", F.col("_a.claim_id")).withColumn("link", kind).drop("_a")


def merged(rules: DataFrame, models: DataFrame, key: list[str]) -> DataFrame:
    """Claims of both extractors by key; where both have one the rule's row stays, as hybrid."""
    a, b = rules.select(*key, F.col("confidence").alias("_a")), models.select(*key, F.col("confidence").alias("_b"))
    method = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "hybrid").when(F.col("_a").isNotNull(), "rule").otherwise("model")
    return a.join(b, key, "full_outer").select(*key, F.coalesce("_a", "_b").alias("confidence"), method.alias("method"))


def merged_links(opinions: DataFrame, key: list[str]) -> DataFrame:
    """One link for each key: contradicts if any opinion does, else supports if any does, else neutral."""
    rank = F.max(F.when(F.col("link") == "contradicts", 2).when(F.col("link") == "supports", 1).otherwise(0))
    return opinions.groupBy(*key).agg(rank.alias("_r")).select(*key, F.when(F.col("_r") == 2, "contradicts").when(F.col("_r") == 1, "supports").otherwise("neutral").alias("link"))


def overlapping(intervals: DataFrame, key: list[str], width_days: int = 365) -> DataFrame:
    """Pairs (a < b by id) of one key whose [from, to) overlap; null ends are open.

    A bounded interval lies in the year buckets that it touches, and two meet in the first
    bucket that both touch.  Open ones, which overlap most of their key, meet its
    intervals once and are in no bucket.  What ends before it begins overlaps nothing.
    """
    rows = intervals.select("id", *key, (F.col("valid_from").isNull() | F.col("valid_to").isNull()).alias("open"), F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("f"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("t")).filter("f <= t")
    day = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width_days)
    side = lambda df, n: df.select(*key, *[F.col(c).alias(f"{c}_{n}") for c in ("id", "f", "t")], *[c for c in ("b",) if c in df.columns])
    bucketed = rows.filter("not open").withColumn("b", F.explode(F.sequence(day("f"), day("t"))))
    shut = side(bucketed, "a").join(side(bucketed, "b"), [*key, "b"]).filter(F.col("b") == F.greatest(day("f_a"), day("f_b"))).drop("b")
    one, rest = rows.filter("open"), rows.filter("not open")
    ends = shut.unionByName(side(one, "a").join(side(rows, "b"), key)).unionByName(side(rest, "a").join(side(one, "b"), key))
    return ends.filter("id_a < id_b and f_a < t_b and f_b < t_a").select(*key, "id_a", "id_b")


def competing(claims: DataFrame, key: list[str]) -> DataFrame:
    """Keys with several predicates, and the predicates."""
    return claims.groupBy(*key).agg(F.array_sort(F.collect_set("predicate")).alias("predicates"), F.count("*").alias("claims")).filter(F.size("predicates") > 1)


def quality_checked(claims: DataFrame, floor: float, longest: int) -> DataFrame:
    """Adds codes of failed checks and the outcome: dead_letter for fatal ones, quarantine for others, accept for none."""
    checks = [("missing_subject", F.coalesce(F.length("subject"), F.lit(0)) == 0), ("missing_object", F.coalesce(F.length("object"), F.lit(0)) == 0), ("low_confidence", F.col("confidence") < floor), ("long_text", F.length("source_text") > longest)]
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in checks]))
    fatal = F.exists("codes", lambda c: c.startswith("missing_"))
    return claims.withColumn("codes", codes).withColumn("outcome", F.when(fatal, "dead_letter").when(F.size("codes") > 0, "quarantine").otherwise("accept"))


def affected(links: DataFrame, changed: DataFrame) -> DataFrame:
    return links.join(changed.select("claim_id"), "claim_id", "left_semi").select("assertion_id").distinct()


def resolved(mentions: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention -> concept: exact name 1.0, alias .95, else unresolved; several hits: the least concept."""
    exact = names.select(F.lower("name").alias("_m"), "concept").groupBy("_m").agg(F.min("concept").alias("_exact"))
    alias = aliases.select(F.lower("alias").alias("_m"), "concept").groupBy("_m").agg(F.min("concept").alias("_alias"))
    rows = mentions.withColumn("_m", F.lower(F.trim("mention"))).join(exact, "_m", "left").join(alias, "_m", "left")
    return rows.withColumn("concept", F.coalesce("_exact", "_alias")).withColumn("confidence", F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_alias").isNotNull(), 0.95).otherwise(0.0)).withColumn("tier", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").otherwise("unresolved")).drop("_m", "_exact", "_alias")


def extraction_scores(truth: DataFrame, found: DataFrame, key: list[str], unit: str) -> DataFrame:
    """True positives, misses and false alarms by unit, and over all."""
    t, f = truth.select(unit, *key).distinct().withColumn("_t", F.lit(1)), found.select(unit, *key).distinct().withColumn("_f", F.lit(1))
    j = t.join(f, [unit, *key], "full_outer")
    return j.rollup(unit).agg(F.count(F.when(F.col("_t").isNotNull() & F.col("_f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"), F.count(F.when(F.col("_t").isNull(), 1)).alias("fp"))


def any_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a | b, rules)


def recomputed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Assertions of key (confidence, status) before and after: both states, what changed, and the edges they give.

    A new assertion was active with confidence 0; one that is no longer there isn't recomputed.
    """
    kind = lambda df, n: derived_edges(df).select(*key, F.col("confidence").alias(f"{n}_confidence"), F.col("status").alias(f"{n}_status"), F.col("edge").alias(f"{n}_edge"))
    j = kind(after, "new").join(kind(before, "previous"), key, "left").withColumns({"previous_confidence": F.coalesce("previous_confidence", F.lit(0.0)), "previous_status": F.coalesce("previous_status", F.lit("active"))})
    return j.withColumns({"confidence_changed": F.abs(F.col("new_confidence") - F.col("previous_confidence")) > UNCHANGED, "status_changed": F.col("new_status") != F.col("previous_status")})


def high_impact_reviews(claims: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Claims of predicates that do harm when wrong, below the threshold."""
    return claims.filter(F.col("predicate").isin(*HIGH_IMPACT) & (F.col("confidence") < threshold))


def event_claims(events: DataFrame, lane: str = "narrative") -> DataFrame:
    """Claims of events (doc_id, event_type, actor, action, object, quantity, time_ref, confidence) with an actor and a known type."""
    q = T.quantity(F.trim("quantity"))
    rows = events.withColumns({"subject": F.trim("actor"), "object": F.nullif(F.trim("object"), F.lit("")), "predicate": T.lookup(F.col("event_type"), EVENT_PREDICATES)}).filter("subject <> '' and predicate is not null")
    rows = rows.withColumns({"numeric_value": q["value"], "unit": q["unit"], "confidence": F.coalesce("confidence", F.lit(0.7)), "modality": T.modality(F.coalesce("action", F.lit(""))), "period": T.period_of(F.col("time_ref"), F.lit(None).cast("int"))})
    rows = rows.withColumn("metric", T.metric_of(F.col("event_type"), F.col("action"), F.col("unit")))
    key = [F.lit(lane), F.col("doc_id").cast("string"), F.col("subject"), F.col("predicate"), F.coalesce("object", F.lit(""))]
    return rows.withColumn("claim_key", T.keyed_id("ck", *key)).select("doc_id", "claim_key", "subject", "predicate", "object", "confidence", "metric", "numeric_value", "unit", "period", "modality")


def cooccurrence_claims(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, subject, predicate, object, confidence): companies named within NEAR characters, with a verb in the stretch.

    entities: doc_id, n (place in the document's list), text, type, start.  documents:
    doc_id, content.  Pairs meet by stretches of NEAR characters, so a document's far
    names never meet.  Each occurrence of a pair gives the first predicate of its
    verbs that the pair hasn't had.
    """
    named = entities.filter(F.upper("type").isin("COMPANY", "TICKER", "ORG") & (F.trim("text") != "")).select("doc_id", "n", F.trim("text").alias("text"), F.coalesce("start", F.lit(0)).alias("start")).withColumn("cell", F.floor(F.col("start") / NEAR))
    b = named.select("doc_id", F.col("n").alias("m"), F.col("text").alias("other"), F.col("start").alias("at"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = named.join(b, ["doc_id", "cell"]).filter((F.col("n") < F.col("m")) & (F.lower("text") != F.lower("other")) & (F.abs(F.col("start") - F.col("at")) <= NEAR))
    stretch = F.substring(F.col("content"), F.least("start", "at") + 1, F.lit(NEAR))
    told = F.array_compact(F.array(*[F.when(F.col("_s").rlike(p), F.lit(v)) for v, p in VERBS.items()]))
    occurring = near.join(documents, "doc_id").withColumn("_s", stretch).withColumn("_v", told).filter(F.size("_v") > 0)
    pair = [F.least(F.lower("text"), F.lower("other")).alias("_a"), F.greatest(F.lower("text"), F.lower("other")).alias("_b")]
    grouped = occurring.groupBy("doc_id", *pair).agg(F.array_sort(F.collect_list(F.struct("n", "m", "text", "other", "_v"))).alias("_o"))
    start = F.expr("cast(array() as array<struct<subject:string,predicate:string,object:string>>)")

    def step(made, o):
        new = F.try_element_at(F.filter(o["_v"], lambda v: ~F.exists(made, lambda x: x["predicate"] == v)), F.lit(1))
        return F.when(new.isNull(), made).otherwise(F.concat(made, F.array(F.struct(o["text"].alias("subject"), new.alias("predicate"), o["other"].alias("object")))))

    return grouped.select("doc_id", F.explode(F.aggregate("_o", start, step)).alias("c")).select("doc_id", "c.*", F.lit(SURE_PAIR).alias("confidence"))
