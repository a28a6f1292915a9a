"""Market structure and filings: anomaly levels with persistence, fact deltas, restatements, margins, drift, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values
SHORT_WATCH, SHORT_EXTREME, FTD_WATCH, FTD_EXTREME = 0.5, 0.75, 1e6, 1e7
Z_CAP, UNUSUAL = 3.0, 1.5


def short_level(ratio: Column) -> Column:
    return F.when(ratio >= SHORT_EXTREME, "extreme").when(ratio >= SHORT_WATCH, "watch").otherwise("none")


def ftd_level(notional: Column) -> Column:
    return F.when(notional >= FTD_EXTREME, "extreme").when(notional >= FTD_WATCH, "watch").otherwise("none")


def next_weekday(day: Column) -> Column:
    """The next day that is neither Saturday nor Sunday."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def persistence(events: DataFrame, key: list[str]) -> DataFrame:
    """Adds persistence: 0 where level is none, else the length so far of the run of days with a level.

    A run ends at a day without a level or when a weekday is missing (reset_reason
    'gap').  Runs are islands between resets, found by a running sum.
    """
    by = W.partitionBy(*key).orderBy("day")
    before, level_before = F.lag("day").over(by), F.lag("level").over(by)
    gap = before.isNotNull() & (F.col("day") > next_weekday(before))
    out = events.withColumn("_gap", gap & (level_before != "none") & (F.col("level") != "none"))
    start = (F.col("level") == "none") | before.isNull() | (level_before == "none") | F.col("_gap")
    out = out.withColumn("_start", F.when(start, 1).otherwise(0)).withColumn("_island", F.sum("_start").over(by))
    n = F.row_number().over(W.partitionBy(*key, "_island").orderBy("day"))
    return out.withColumn("persistence", F.when(F.col("level") == "none", 0).otherwise(n)).withColumn("reset_reason", F.when(F.col("_gap"), "gap")).drop("_gap", "_start", "_island")


def latest_per_period(facts: DataFrame, key: list[str]) -> DataFrame:
    return facts.withColumn("_n", F.row_number().over(W.partitionBy(*key, "period_end").orderBy(F.desc("filed"), F.desc("accession")))).filter("_n = 1").drop("_n")


def fact_deltas(facts: DataFrame, key: list[str]) -> DataFrame:
    """Changes between consecutive periods' last filings; equal values give no event."""
    rows = latest_per_period(facts, key)
    by = W.partitionBy(*key).orderBy("period_end", "filed", "accession")
    rows = rows.withColumn("previous", F.lag("value").over(by)).filter("previous is not null and previous <> value")
    return rows.withColumn("delta", F.col("value") - F.col("previous")).withColumn("relative", F.when(F.col("previous") != 0, F.col("delta") / F.col("previous"))).withColumn("available_at", F.to_date("filed").cast("timestamp_ntz"))


def restatements(facts: DataFrame, key: list[str]) -> DataFrame:
    """Filings of one fact and period whose value differs from the filing's before."""
    by = W.partitionBy(*key, "period_end").orderBy("filed", "accession")
    return facts.withColumn("previous", F.lag("value").over(by)).filter("previous is not null and previous <> value")


def margins(profit: DataFrame, revenue: DataFrame, key: list[str]) -> DataFrame:
    """Gross margin by key and period and its change; compressed where it fell."""
    rows = profit.select(*key, "period_end", F.col("value").alias("profit")).join(revenue.select(*key, "period_end", F.col("value").alias("revenue")), [*key, "period_end"]).filter("revenue <> 0").withColumn("margin", F.col("profit") / F.col("revenue"))
    before = F.lag("margin").over(W.partitionBy(*key).orderBy("period_end"))
    return rows.withColumn("change", F.col("margin") - before).withColumn("compressed", F.coalesce(F.col("change") < 0, F.lit(False)))


def capped_z(value: Column, mean: Column, spread: Column) -> Column:
    flat = F.when(value > mean, F.lit(Z_CAP)).when(value < mean, F.lit(-Z_CAP)).otherwise(0.0)
    return F.when(mean.isNull(), 0.0).when(F.abs(value - mean) < 1e-10, 0.0).when(spread < 1e-10, flat).otherwise(F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), (value - mean) / spread)))


def drift_against_peers(changes: DataFrame, issuer: str = "issuer", dimension: str = "dimension", value: str = "magnitude") -> DataFrame:
    """Each issuer's mean magnitude by dimension against all other issuers' (mean, sample deviation), capped z.

    Sums over all issuers less the issuer's own give the peers.
    """
    own = changes.groupBy(issuer, dimension).agg(F.avg(value).alias("m"))
    sums = own.groupBy(dimension).agg(F.count("*").alias("_n"), F.sum("m").alias("_s"), F.sum(F.col("m") * F.col("m")).alias("_q"))  # summed before the shuffle
    own = own.join(sums, dimension)
    n, s, q = F.col("_n") - 1, F.col("_s") - F.col("m"), F.col("_q") - F.col("m") * F.col("m")
    mean = F.when(n > 0, s / n)
    var = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))).otherwise(0.0)
    out = own.withColumn("peer_mean", mean).withColumn("peer_spread", F.sqrt(var)).drop("_n", "_s", "_q")
    return out.withColumn("z", capped_z(F.col("m"), F.col("peer_mean"), F.col("peer_spread"))).withColumn("unusual", F.abs("z") >= UNUSUAL)


def with_security(events: DataFrame, securities: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Left join with the security master; events without a security keep their symbol and are unresolved."""
    out = events.join(securities.select(symbol, "security_id", "security_name"), symbol, "left")
    return out.withColumn("mapping_status", F.when(F.col("security_id").isNull(), "unresolved").otherwise("resolved")).withColumn("security_name", F.coalesce("security_name", symbol))


def reconciled(snapshot: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """key, name, action: insert, update, keep or deactivate."""
    joined = snapshot.select(*key, F.col("name").alias("_new")).join(known.select(*key, F.col("name").alias("_old")), key, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "deactivate").when(F.col("_new") != F.col("_old"), "update").otherwise("keep")
    return joined.select(*key, F.coalesce("_new", "_old").alias("name"), action.alias("action"))


def keyed_diff(current: DataFrame, shadow: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """key, severity: missing on a side, minor within the tolerance, material beyond; equal values give no row."""
    a, b = current.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), shadow.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, key, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    severity = F.when(F.col("_in_b").isNull(), "missing_in_shadow").when(F.col("_in_a").isNull(), "missing_in_current").when(F.col("_a").eqNullSafe(F.col("_b")), None).when(gap <= tolerance, "minor").otherwise("material")
    return joined.select(*key, "_a", "_b", severity.alias("severity")).filter("severity is not null").withColumnsRenamed({"_a": "current", "_b": "shadow"})


def gates(metrics: DataFrame, spec: DataFrame) -> DataFrame:
    """spec (metric, least) with the metric's value; a missing metric fails."""
    return spec.join(metrics, "metric", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


# Event types with class, label, reason, family and usual severity
PLUMBING = {
    "form4_non_derivative_transaction": ("insider_ownership", "Insider ownership transaction", "sec_form4_insider_transaction", "sec_ownership", "info"),
    "form4_derivative_transaction": ("insider_ownership", "Insider ownership transaction", "sec_form4_derivative_transaction", "sec_ownership", "info"),
    "schedule_13d_ownership": ("activist_ownership", "Activist ownership disclosure", "sec_schedule_13d_ownership", "sec_ownership", "warning"),
    "schedule_13g_ownership": ("institutional_holdings", "Institutional holdings update", "sec_schedule_13g_ownership", "sec_ownership", "info"),
    "13f_position": ("institutional_holdings", "Institutional holdings update", "sec_13f_position_change", "sec_ownership", "info"),
    "finra_short_volume": ("short_volume_anomaly", "Short-volume anomaly", "finra_short_volume_ratio", "market_structure", "warning"),
    "sec_fail_to_deliver": ("fails_to_deliver_anomaly", "Fails-to-deliver anomaly", "sec_fails_to_deliver_notional", "market_structure", "warning"),
}


def plumbing_signals(events: DataFrame) -> DataFrame:
    """Alerts and read-model payloads of ownership and market-structure events; market-structure events without an anomaly give none.

    events: event_id, event_type, anomaly_level, ticker, issuer_cik.  Adds signal_class, reason_code,
    severity, subject_id, title and payload (the event with its class, as JSON).
    """
    spec = F.create_map(*[x for k, v in PLUMBING.items() for x in (F.lit(k), F.struct(*[F.lit(p).alias(n) for n, p in zip(("signal_class", "signal_label", "reason_code", "source_family", "usual"), v, strict=True)]))])
    rows = events.withColumn("_s", spec[F.col("event_type")]).filter("_s is not null").filter("_s.source_family <> 'market_structure' or anomaly_level <> 'none'")
    market = F.col("_s.source_family") == "market_structure"
    severity = F.when(market & (F.col("anomaly_level") == "extreme"), "critical").when(market & F.col("anomaly_level").isin("elevated", "watch"), "warning").otherwise(F.col("_s.usual"))
    subject = F.coalesce("ticker", "issuer_cik", F.col("event_id").cast("string"))
    payload = F.to_json(F.struct(F.lit("market_plumbing_signal").alias("object_type"), "event_id", F.col("_s.signal_class").alias("signal_class"), F.col("_s.reason_code").alias("reason_code"), F.col("_s.source_family").alias("source_family"), F.struct(*events.columns).alias("event")))
    return rows.select(*events.columns, F.col("_s.signal_class").alias("signal_class"), F.col("_s.reason_code").alias("reason_code"), severity.alias("severity"), subject.alias("subject_id"), F.concat("_s.signal_label", F.lit(": "), subject).alias("title"), payload.alias("payload"))
