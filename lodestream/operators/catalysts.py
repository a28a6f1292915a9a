"""Market catalysts: a narrative run with its events, what it spreads to, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scoring as S, text as T

# Fixed values
LEADS = {"bullish": "Bullish setup", "bearish": "Bearish setup", "mixed": "Mixed setup"}


def dominant_events(events: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """(key, events, dominant): the most frequent event types, ties by name."""
    counts = events.groupBy(key, "event_type").agg(F.count("*").alias("n"))
    rows = counts.groupBy(key).agg(F.sum("n").alias("events"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))).alias("_e"))  # a row for each type
    return rows.select(key, "events", F.slice(F.transform("_e", lambda e: e["event_type"]), 1, limit).alias("dominant"))


def summary(name: Column, bias: Column, primary: Column, signal: Column, events: Column, platforms: Column, z: Column, conviction: Column, related: Column) -> Column:
    """One or two sentences; primary, events and related are arrays, best first."""
    dollar = lambda c, n: F.array_join(F.transform(F.slice(c, 1, n), lambda t: F.concat(F.lit("$"), t)), ", ")
    or_else = lambda c, text: F.when(c == "", text).otherwise(c)
    told = F.coalesce(T.lookup(signal, S.SIGNAL_LABELS), F.lower(T.humanized(signal)))
    event_text = or_else(F.array_join(F.transform(F.slice(events, 1, 2), lambda e: F.replace(e, F.lit("_"), F.lit(" "))), ", "), "cross-platform narrative momentum")
    body = F.concat(
        name, F.lit(" is spreading across "), platforms.cast("string"), F.lit(" platforms"), F.when(signal.isNotNull(), F.concat(F.lit(" with "), told)).otherwise(F.concat(F.lit(" around "), event_text)),
        F.when(z > 0, F.concat(F.lit(", backed by volume z-score "), F.format_string("%.1f", z))).otherwise(""), F.lit(" and conviction "), F.rint(conviction).cast("long").cast("string"), F.lit("."),
    )
    tail = F.when(F.size(related) > 0, F.concat(F.lit("Watch follow-through in "), dollar(related, 2), F.lit(".")))
    return F.concat_ws(" ", F.concat(T.lookup(bias, LEADS, "Live setup"), F.lit(" for "), or_else(dollar(primary, 3), "linked equities"), F.lit(".")), body, tail)


def catalysts(runs: DataFrame, events: DataFrame, metrics: DataFrame, impacts: DataFrame) -> DataFrame:
    """A row for each run: bias, delta, impact score, primary and related tickers, dominant events, summary.

    runs: run_id, theme_id, theme_name, avg_sentiment, avg_authority, conviction,
    acceleration, platforms, ticker_counts (map).  events: theme_id, event_type (linked and de-duplicated), with
    investment_signal by theme.  metrics: theme_id, date, volume_zscore, avg_authority; the
    latest counts.  impacts: source, target, impact, of a unit delta at a source.
    """
    latest = metrics.groupBy("theme_id").agg(F.max_by(F.struct("volume_zscore", "avg_authority"), "date").alias("_m"))
    told = dominant_events(events, "theme_id").join(events.groupBy("theme_id").agg(F.max("investment_signal").alias("signal")), "theme_id")
    ordered = F.array_sort(F.transform(F.map_entries("ticker_counts"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("ticker"))))
    rows = runs.join(told, "theme_id", "left").join(latest, "theme_id", "left").withColumn("primary", F.transform(F.slice(ordered, 1, 3), lambda e: e["ticker"]))
    rows = rows.withColumn("bias", S.market_bias(F.col("avg_sentiment"), F.col("signal"))).withColumn("delta", S.propagation_delta(F.col("avg_sentiment"), F.col("bias")))

    reached = rows.filter("delta <> 0").select("run_id", "delta", "primary", F.explode("primary").alias("source")).join(impacts, "source").filter(~F.array_contains("primary", F.col("target")))
    best = reached.withColumn("impact", F.round(F.col("impact") * F.col("delta"), 4)).groupBy("run_id", "target").agg(F.max(F.abs("impact")).alias("size"))
    top = best.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("size"), "target"))).filter("_n <= 5")
    related = top.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "target"))), lambda x: x["target"]).alias("related"))

    none = F.expr("cast(array() as array<string>)")
    out = rows.join(related, "run_id", "left").withColumns({"related": F.coalesce("related", none), "dominant": F.coalesce("dominant", none), "events": F.coalesce("events", F.lit(0))})
    z = F.col("_m.volume_zscore")
    score = F.round(S.market_impact(F.col("conviction"), z, F.col("acceleration"), F.col("platforms"), F.when(F.col("_m").isNotNull(), F.col("_m.avg_authority")).otherwise(F.col("avg_authority")), F.col("events")), 2)
    text = summary(T.humanized(F.col("theme_name")), F.col("bias"), F.col("primary"), F.col("signal"), F.col("dominant"), F.col("platforms"), z, F.col("conviction"), F.col("related"))
    return out.select("run_id", "theme_id", "bias", "delta", score.alias("impact_score"), "primary", "related", F.col("dominant").alias("dominant_events"), text.alias("summary"))
