"""Changes to stored rows, as the rows that are there afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def retained(rows: DataFrame, time: str, at: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; a null time goes."""
    return rows.filter(F.col(time) >= at - F.make_interval(days=F.lit(days)))


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return rows.join(ids.select(key), key, "left_anti")


def soft_deleted(rows: DataFrame, which: Column, at: Column) -> DataFrame:
    """Sets deleted_at where ``which`` holds and it isn't set yet."""
    return rows.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def with_added(rows: DataFrame, added: DataFrame, key: str, items: str) -> DataFrame:
    """The union of each row's array ``items`` and the added ones of its key, in order, each once."""
    new = added.groupBy(key).agg(F.array_sort(F.collect_set(items)).alias("_new"))
    none = F.array().cast(rows.schema[items].dataType)
    return rows.join(new, key, "left").withColumn(items, F.array_union(F.coalesce(items, none), F.coalesce("_new", none))).drop("_new")


def merged_entity(rows: DataFrame, old: tuple[str, str], new: tuple[str, str], entities: str = "entities") -> DataFrame:
    """Rewrites (type, normalized) of matching array elements; ``affected`` tells which rows had one."""
    match = lambda e: (e["type"] == old[0]) & (e["normalized"] == old[1])
    put = lambda e: e.withField("type", F.lit(new[0])).withField("normalized", F.lit(new[1]))
    out = rows.withColumn("affected", F.coalesce(F.exists(entities, match), F.lit(False)))
    return out.withColumn(entities, F.transform(entities, lambda e: F.when(match(e), put(e)).otherwise(e)))


def position_changes(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """Holdings with the earlier number of shares and the difference, null if either side is unknown."""
    old = previous.filter(F.col(key[-1]).isNotNull()).select(*key, F.col("shares").alias("previous_shares"))
    return current.join(old, key, "left").withColumn("delta_shares", F.col("shares") - F.col("previous_shares"))
