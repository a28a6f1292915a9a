"""Lists of published objects and stored rows: latest versions first, filters after, pages and counts.

Published objects have a JSON payload.  Filters come after the latest version of
each logical object is chosen, so an older version never shows for a newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .publish import latest_objects


def field(path: str, payload: str = "payload") -> Column:
    return F.get_json_object(payload, f"$.{path}")


def confidence(payload: str = "payload") -> Column:
    """The payload's confidence where it is written as a number, else 0."""
    c = field("confidence", payload)
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), c.cast("double")).otherwise(0.0)


def published(objects: DataFrame, pointers: DataFrame, kind: str, logical: str) -> DataFrame:
    """The latest version of each published object of a kind within the active manifests; logical: the payload's key of it."""
    rows = objects.filter((F.col("object_type") == kind) & (F.col("publish_state") == "published")).withColumn("logical_id", field(logical))
    return latest_objects(rows, pointers)


def assertions(objects: DataFrame, pointers: DataFrame, concept: str | None = None, predicate: str | None = None, status: str | None = None, least: float | None = None) -> DataFrame:
    rows = published(objects, pointers, "assertion", "assertion_id")
    if concept is not None:
        rows = rows.filter((field("subject_concept_id") == concept) | (field("object_concept_id") == concept))
    if predicate is not None:
        rows = rows.filter(field("predicate") == predicate)
    if status is not None:
        rows = rows.filter(field("status") == status)
    return rows if least is None else rows.filter(confidence() >= least)


def claims(objects: DataFrame, pointers: DataFrame, assertion: str | None = None) -> DataFrame:
    """Latest claims; of an assertion: those that name it in any of their link fields, or that it names."""
    rows = published(objects, pointers, "claim", "claim_id")
    if assertion is None:
        return rows
    a = assertions(objects, pointers).filter(F.coalesce(F.nullif(F.col("logical_id"), F.lit("")), F.col("object_id").cast("string")) == assertion)
    embedded = a.select(F.explode(F.from_json(field("claim_ids"), "array<string>")).alias("_claim")).distinct()
    key = F.coalesce(F.nullif(F.col("logical_id"), F.lit("")), F.col("object_id").cast("string"))
    named = (field("assertion_id") == assertion) | (field("linked_assertion_id") == assertion) | F.array_contains(F.from_json(field("assertion_ids"), "array<string>"), assertion)
    named = named | F.exists(F.from_json(field("links"), "array<struct<assertion_id:string>>"), lambda x: x["assertion_id"] == assertion)
    return rows.withColumn("_claim", key).join(embedded.withColumn("_in", F.lit(True)), "_claim", "left").filter(F.coalesce(named, F.lit(False)) | F.col("_in")).drop("_claim", "_in")


def linked_claims(objects: DataFrame, pointers: DataFrame) -> DataFrame:
    """(assertion_id, claim_id, link): every latest assertion with its latest claims, one row a pair."""
    a = assertions(objects, pointers).select(F.coalesce(F.nullif(F.col("logical_id"), F.lit("")), F.col("object_id").cast("string")).alias("assertion_id"), F.from_json(field("claim_ids"), "array<string>").alias("_c"))
    c = claims(objects, pointers).select(F.coalesce(F.nullif(F.col("logical_id"), F.lit("")), F.col("object_id").cast("string")).alias("claim_id"), field("assertion_id").alias("_a"))
    down = a.select("assertion_id", F.explode("_c").alias("claim_id")).join(c.select("claim_id"), "claim_id", "left_semi")
    up = c.filter("_a is not null").select(F.col("_a").alias("assertion_id"), "claim_id").join(a.select("assertion_id"), "assertion_id", "left_semi")
    return down.select("assertion_id", "claim_id").union(up).distinct()


def divergences(objects: DataFrame, pointers: DataFrame, issuer: str | None = None) -> DataFrame:
    rows = published(objects, pointers, "divergence", "divergence_id").withColumns({"severity": F.coalesce(field("severity"), F.lit("info")), "issuer": field("issuer_concept_id")})
    return rows if issuer is None else rows.filter(F.col("issuer") == issuer)


def relationships(rows: DataFrame, concept: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Active relationships that have the concept as source (out), target (in) or either."""
    end = {"out": F.col("source") == concept, "in": F.col("target") == concept}.get(direction, (F.col("source") == concept) | (F.col("target") == concept))
    rows = rows.filter(F.col("is_active") & end)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def of_concept(assertions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Assertions with one of the concepts on either side, each once for a concept; concepts: concept."""
    ends = assertions.withColumn("concept", F.explode(F.array_distinct(F.array("subject", "object"))))
    return ends.join(concepts.distinct(), "concept", "left_semi")


def series(rows: DataFrame, active_only: bool = True, tag: str | None = None, provider: str | None = None) -> DataFrame:
    rules = [r for r, on in ((F.col("is_active"), active_only), (F.array_contains("tags", tag), tag is not None), (F.col("provider") == provider, provider is not None)) if on]
    for rule in rules:
        rows = rows.filter(rule)
    return rows


def recent(rows: DataFrame, rules: list[Column], at: str, limit: int | None = None, *ties: str) -> DataFrame:
    """Rows that meet all rules, newest first."""
    for rule in rules:
        rows = rows.filter(rule)
    rows = rows.orderBy(F.desc(at), *ties)
    return rows if limit is None else rows.limit(limit)


def momentum(runs: DataFrame, themes: DataFrame, limit: int) -> DataFrame:
    """Open runs with their theme's name by conviction, rate and acceleration."""
    return runs.filter("status <> 'closed'").join(themes, "theme_id").orderBy(F.desc("conviction"), F.desc("rate"), F.desc("acceleration"), "run_id").limit(limit)


def events_of(documents: DataFrame, tickers: list[str], since: Column, until: Column, kind: str | None = None) -> DataFrame:
    """Events (an array of structs with event_type and tickers) of documents in [since, until] that share a ticker with the list."""
    rows = documents.filter((F.col("ts") >= since) & (F.col("ts") <= until)).select("doc_id", "ts", F.explode("events").alias("e")).filter(F.arrays_overlap("e.tickers", F.array(*[F.lit(t) for t in tickers])))
    return rows if kind is None else rows.filter(F.col("e.event_type") == kind)


def cited(answers: DataFrame, valid: DataFrame, key: str = "entries") -> DataFrame:
    """(answer_id, pos, text, claim_ids) of JSON answers: entries with a text and at least one valid citation, others of theirs stripped.

    valid: answer_id, claim_id.  Malformed payloads give no row.
    """
    e = answers.select("answer_id", F.posexplode(F.from_json(F.get_json_object("payload", f"$.{key}"), "array<struct<text:string,claim_ids:array<string>>>")).alias("pos", "e")).select("answer_id", "pos", F.trim("e.text").alias("text"), F.posexplode(F.array_distinct("e.claim_ids")).alias("_n", "claim_id"))
    good = e.filter("text <> ''").join(valid.distinct(), ["answer_id", "claim_id"], "left_semi")
    return good.groupBy("answer_id", "pos", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))


def claims_block(claims: DataFrame, key: str) -> DataFrame:
    """(key, block): '- [claim_id] text' lines in the order of the ids."""
    return claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_id", "text"))).alias("_c")).select(key, F.array_join(F.transform("_c", lambda c: F.concat(F.lit("- ["), c["claim_id"].cast("string"), F.lit("] "), c["text"])), "\n").alias("block"))


def verdict(payload: Column, relations: list[str]) -> Column:
    """struct(relation, confidence within 0 to 1) of a JSON verdict; null if its relation is unknown or its confidence no number."""
    relation, sure = F.get_json_object(payload, "$.relation"), F.get_json_object(payload, "$.confidence")
    # get_json_object drops the quotes of a string: a number is one that the payload doesn't quote
    number = ~payload.rlike(r'"confidence"\s*:\s*"') & sure.try_cast("double").isNotNull()
    return F.when(relation.isin(*relations) & number, F.struct(relation.alias("relation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure.try_cast("double"))).alias("confidence")))


def grouped_evidence(signals: DataFrame, by: str) -> DataFrame:
    """(concept or theme, evidence): signal payloads by issuer and security concept, or by theme; a signal whose two concepts are one counts once.

    A concept's evidence is collected, so this is for published selections, not for a corpus.
    """
    payload = F.struct("event_date", "signal_id", "title", "confidence")
    key = F.explode(F.array_distinct(F.array_compact(F.array("issuer_concept_id", "security_concept_id")))) if by == "concept" else F.col("theme_id")
    return signals.select(key.alias(by), payload.alias("p")).groupBy(by).agg(F.array_sort(F.collect_list("p")).alias("evidence"))
