"""Comparisons of runs: replays, backfills, components against convictions; gates of a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values
TOLERANCE, DIRECTION, STRONG = 0.01, 20.0, 0.3
COOLING, CLOSING = "2 hours", "24 hours"


def backfill_issues(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, issues, passed) of runs on either side: counts must be equal, sentiment and authority within TOLERANCE; a run on one side only is an issue."""
    names = ["doc_count", "platform_count", "avg_sentiment", "avg_authority"]
    side = lambda df, n: df.select(key, F.lit(True).alias(f"_{n}"), *[F.col(c).alias(f"{n}_{c}") for c in names])
    j = side(a, "a").join(side(b, "b"), key, "full_outer")
    differs = lambda c: F.col(f"a_{c}") != F.col(f"b_{c}") if c.endswith("count") else F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > TOLERANCE
    found = F.array_compact(F.array(F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing"), *[F.when(differs(c), c) for c in names]))
    return j.select(key, F.concat_ws(",", found).alias("issues"), (F.size(found) == 0).alias("passed"))


def replay_covered(triggered: Column, *components: Column) -> Column:
    """Whether a signal that fired has a strong component; true for one that didn't."""
    strong = F.lit(False)
    for c in components:
        strong = strong | (c > STRONG)
    return ~triggered | strong


def conviction_agrees(composite: Column, conviction: Column) -> Column:
    return F.abs(composite - conviction) <= DIRECTION


def maintained(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with their status after maintenance: active ones cool after 2 hours without a document, both close after 24."""
    idle = lambda span: F.col("last_document_at") < now - F.expr(f"interval {span}")
    status = F.when(F.col("status").isin("active", "cooling") & idle(CLOSING), "closed").when((F.col("status") == "active") & idle(COOLING), "cooling").otherwise(F.col("status"))
    return runs.withColumn("closed_at", F.when((status == "closed") & F.col("closed_at").isNull(), now).otherwise(F.col("closed_at"))).withColumn("status", status)


def selected_runs(candidates: DataFrame, least: float, now: Column, recent: int = 5) -> DataFrame:
    """For each document its most similar run among the most recent open ones of its theme, if similar enough.

    candidates: doc_id, run_id, status, last_document_at, similarity.  Closed runs and
    cooling ones that are due to close are none; the later run wins a tie.
    """
    newest = W.partitionBy("doc_id").orderBy(F.desc("last_document_at"), "run_id")
    rows = candidates.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= recent)
    due = (F.col("status") == "cooling") & (F.col("last_document_at") < now - F.expr(f"interval {CLOSING}"))
    return rows.filter((F.col("status") != "closed") & ~due & (F.col("similarity") >= least)).groupBy("doc_id").agg(F.max_by("run_id", F.struct("similarity", -F.col("_n"))).alias("run_id"))


def fallback_gate(asked: DataFrame, enabled: bool, shortest: int, predicates: list[str], daily: int, per_run: int) -> DataFrame:
    """Adds deny_reason (null: approved) to requests (asked_at, id, passage_length, predicate, run_id): switch, length, predicate, then both budgets.

    Requests that pass the first three rules spend the budgets in their order; a day's
    budget counts what was approved that day, a run's what was approved for it.
    """
    rule = F.when(~F.lit(enabled), "master_disabled").when(F.col("passage_length") < shortest, "passage_too_short").when(F.col("predicate").isNotNull() & ~F.col("predicate").isin(*predicates), "predicate_not_high_value")
    rows = asked.withColumns({"_rule": rule, "_day": F.to_date("asked_at"), "_run": F.coalesce(F.col("run_id").cast("string"), F.concat(F.lit("none-"), F.col("id").cast("string")))})
    open_ = rows.filter("_rule is null")
    # a run's own budget first: what lies beyond it never spends the day's
    in_run = F.row_number().over(W.partitionBy("_run").orderBy("asked_at", "id"))
    ranked = open_.withColumn("_k", in_run)
    within = ranked.filter(F.col("_k") <= per_run).withColumn("_d", F.row_number().over(W.partitionBy("_day").orderBy("asked_at", "id")))
    day = within.select("id", "_d")
    spent = within.filter(F.col("_d") == daily).select("_day", F.struct("asked_at", "id").alias("_last"))  # when a day's budget went
    out = rows.join(ranked.select("id", "_k"), "id", "left").join(day, "id", "left").join(spent, "_day", "left")
    late = F.col("_last").isNotNull() & (F.struct("asked_at", "id") > F.col("_last"))
    reason = F.when(F.col("_rule").isNotNull(), F.col("_rule")).when(late | (F.col("_d") > daily), "daily_budget_exhausted").when(F.col("_k") > per_run, "run_budget_exhausted")
    return out.withColumn("deny_reason", reason).drop("_rule", "_day", "_run", "_k", "_d", "_last")
