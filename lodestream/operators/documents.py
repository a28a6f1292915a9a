"""Document filters, search, statistics, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..sources.scratch import table


def _equals(term: str):
    return lambda x: x == term


def filtered(docs: DataFrame, predicates: list[Column], inactive_sources: DataFrame | None = None, source: str = "source") -> DataFrame:
    """Rows for which all predicates hold and whose source isn't inactive (a null source passes)."""
    out = docs.filter(reduce(lambda a, b: a & b, predicates)) if predicates else docs
    return out if inactive_sources is None else out.join(inactive_sources.select(source).distinct(), source, "left_anti")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def in_order_of(rows: DataFrame, ids: list, id_col: str) -> DataFrame:
    """Rows with the listed ids and their place in the list."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} long, pos int")
    return rows.join(F.broadcast(wanted), id_col)


def term_search(docs: DataFrame, query_terms: list[str], limit: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents with every term, by term frequency per square root of length, then id."""
    w = T.words(F.col(text))
    rows = docs.withColumn("_w", w)
    for t in query_terms:
        rows = rows.filter(F.array_contains("_w", t))
    hits = reduce(lambda a, b: a + b, [F.size(F.filter("_w", _equals(t))) for t in query_terms])
    rank = hits / F.sqrt(F.size("_w").cast("double"))
    return rows.withColumn("rank", rank).drop("_w").orderBy(F.desc("rank"), id_col).limit(limit)


def bm25(docs: DataFrame, query_terms: list[str], k1: float = 1.2, b: float = 0.75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, score of the documents with any of the terms.

    Texts are read once: lengths and frequencies become a table of a few integers a document.
    """
    words = docs.select(id_col, T.words(F.col(text)).alias("_w"))  # cut once: everything else reads the column
    rows = table(words.select(id_col, F.size("_w").alias("len"), *[F.size(F.filter("_w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(query_terms)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(query_terms))])
    joined = rows.filter(" or ".join(f"tf{i} > 0" for i in range(len(query_terms)))).crossJoin(F.broadcast(stats))  # one row
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    score = reduce(lambda x, y: x + y, [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(query_terms))])
    return joined.select(id_col, score.alias("score"))


def coverage(docs: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Count and share of rows that pass each check, by key and (key null, is_total) over all."""
    rows = docs.select(key, *[c.cast("int").alias(n) for n, c in checks.items()])
    shares = [F.avg(F.coalesce(F.col(n), F.lit(0)).cast("double")).alias(f"{n}_share") for n in checks]
    return rows.rollup(key).agg(F.grouping(key).alias("is_total"), F.count("*").alias("documents"), *shares)


def entity_counts(mentions: DataFrame, limit: int, kind: str = "entity") -> DataFrame:
    return mentions.groupBy(kind).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).orderBy(F.desc("mentions"), kind).limit(limit)


def trending(mentions: DataFrame, at: Column, recent_hours: int, baseline_hours: int, limit: int, kind: str = "entity") -> DataFrame:
    """Spike of recent mentions over the baseline's rate; one conditional pass instead of a join of two."""
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3_600_000_000.0)
    rows = mentions.filter((age >= 0) & (age <= recent_hours + baseline_hours)).groupBy(kind).agg(F.count(F.when(age <= recent_hours, 1)).alias("recent"), F.count(F.when((age > recent_hours) & (age <= baseline_hours), 1)).alias("baseline")).filter("recent >= 2")
    spike = F.when(F.col("baseline") == 0, F.col("recent").cast("double")).otherwise(F.col("recent") * F.lit(float(baseline_hours)) / (F.col("baseline") * F.lit(float(recent_hours))))
    return rows.withColumn("spike", F.round(spike, 2)).orderBy(F.desc("spike"), F.desc("recent"), kind).limit(limit)


def cooccurring(mentions: DataFrame, unit: str, target: str, min_count: int, kind: str = "entity") -> DataFrame:
    """Entities that share units with the target, and the share of the target's units they have."""
    pairs = mentions.select(unit, kind).distinct()
    mine = pairs.filter(F.col(kind) == target).select(unit)
    total = mine.agg(F.count("*").alias("n"))
    return pairs.filter(F.col(kind) != target).join(mine, unit, "left_semi").groupBy(kind).agg(F.count("*").alias("together")).filter(F.col("together") >= min_count).crossJoin(F.broadcast(total)).select(kind, "together", (F.col("together") / F.col("n")).alias("overlap_ratio"))


def first_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """old with new's rows by key: new keys are added, of known keys only ``overwrite`` (all but the keys if None) is replaced, also by null."""
    replace = [c for c in old.columns if c not in keys] if overwrite is None else overwrite
    n = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_new"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    joined = o.join(n, keys, "full_outer")
    value = lambda c: F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in replace)), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def rating_stats(feedback: DataFrame, key: str, rating: str) -> DataFrame:
    return feedback.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(rating), 3).alias("average"), F.count(F.when(F.col(rating) >= 1, 1)).alias("positive"), F.count(F.when(F.col(rating) < 1, 1)).alias("negative"))
