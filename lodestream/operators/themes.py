"""Theme metrics: weighted volume, z-scores, velocity, lifecycle, ranking, alerts.

Inputs are set-based: one row a document or one row a theme and day, all themes at once.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values
PLATFORM_WEIGHTS = {"twitter": 1.0, "reddit": 5.0, "news": 20.0, "substack": 100.0}
VOLUME_DECAY, VOLUME_DAYS, HISTORY_DAYS, HISTORY_MIN = 0.3, 7, 30, 7
SURGE_Z, COLLAPSE_Z, AUTHORITY_FLOOR = 3.0, -2.0, 0.1
SHORT_SPAN, LONG_SPAN = 3, 7
STRATEGIES = {"swing": (0.6, 0.4), "position": (0.4, 0.6)}
STAGE_FACTORS = {"emerging": 1.5, "accelerating": 1.2, "mature": 0.8, "fading": 0.3}
DEFAULT_COMPELLINGNESS, DEFAULT_STAGE_FACTOR, SCORE_MIN = 5.0, 0.8, 0.1
SPREAD = 32
TIER_1, TIER_2, TIER_1_Z = 0.05, 0.20, 2.0
LIFECYCLE_ROWS, EMERGING_DOCS, ACCELERATING, FADING = 3, 50, 0.5, -0.3
ALERTABLE = [("accelerating", "fading"), ("accelerating", "mature"), ("emerging", "accelerating"), ("emerging", "fading"), ("mature", "fading")]


def lookup(key: Column, table: dict, default=None) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def days_between(late: Column, early: Column) -> Column:
    """Fractional days; both are timestamps."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(86_400_000_000.0)


def document_volume(platform: Column, age_days: Column, authority: Column) -> Column:
    """Platform weight, exponential decay, authority with a floor."""
    trust = F.when(authority > 0, authority).otherwise(AUTHORITY_FLOOR)
    return lookup(platform, PLATFORM_WEIGHTS, 1.0) * F.exp(F.lit(-VOLUME_DECAY) * age_days) * trust


def daily_volumes(docs: DataFrame, last_day: Column | None = None) -> DataFrame:
    """theme_id, day, weighted_volume, document_count: each day's end sees the VOLUME_DAYS days before it.

    Every document is given to the days that see it, so the sum is one shuffle on (theme, day).
    """
    seen = docs.withColumn("own", F.to_date("ts")).withColumn("day", F.explode(F.sequence("own", F.date_add("own", VOLUME_DAYS), F.expr("interval 1 day"))))
    end = F.col("day").cast("timestamp") + F.expr("interval 1 day")
    age = days_between(end, F.col("ts"))
    found = seen.filter(age <= VOLUME_DAYS)
    return found.groupBy("theme_id", "day").agg(F.sum(document_volume(F.col("platform"), age, F.col("authority"))).alias("weighted_volume"), F.count(F.when(F.col("own") == F.col("day"), 1)).alias("document_count"))


def volume_zscores(daily: DataFrame) -> DataFrame:
    """Adds volume_zscore against the days d-30 to d-1 that have a volume: null under 7, 0 without spread."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    past = W.partitionBy("theme_id").orderBy(day).rangeBetween(-HISTORY_DAYS, -1)
    n, mean, spread = F.count("weighted_volume").over(past), F.avg("weighted_volume").over(past), F.stddev_pop("weighted_volume").over(past)
    z = F.when(n < HISTORY_MIN, None).when(spread < 1e-12, 0.0).otherwise((F.col("weighted_volume") - mean) / spread)
    return daily.withColumn("volume_zscore", z)


def ema(values: Column, span: int) -> Column:
    """Exponential mean of an array, seeded with its first element."""
    a = 2.0 / (span + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda acc, v: v * a + acc * (1 - a))


def velocities(scored: DataFrame) -> DataFrame:
    """Adds velocity (EMA 3 - EMA 7 of the last 30 days' z-scores, null under 7 of them) and acceleration."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    recent = W.partitionBy("theme_id").orderBy(day).rangeBetween(-(HISTORY_DAYS - 1), 0)
    zs = F.transform(F.array_sort(F.filter(F.collect_list(F.struct("day", "volume_zscore")).over(recent), lambda x: x["volume_zscore"].isNotNull())), lambda x: x["volume_zscore"])
    out = scored.withColumn("_zs", zs).withColumn("velocity", F.when(F.size("_zs") >= HISTORY_MIN, ema(F.col("_zs"), SHORT_SPAN) - ema(F.col("_zs"), LONG_SPAN))).drop("_zs")
    return out.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(W.partitionBy("theme_id").orderBy("day")))


def volume_anomaly(z: Column) -> Column:
    return F.when(z >= SURGE_Z, "surge").when(z <= COLLAPSE_Z, "collapse")


def relative_trend(value: str, window) -> Column:
    """Least-squares slope over the frame's rows by their position, divided by the mean's size where that isn't 0."""
    v = F.col(value)
    n = F.count(v).over(window)
    x = F.col("_row")
    sx, sy = F.sum(F.when(v.isNotNull(), x)).over(window), F.sum(v).over(window)
    sxx, sxy = F.sum(F.when(v.isNotNull(), x * x)).over(window), F.sum(x * v).over(window)
    below = n * sxx - sx * sx
    slope = F.when((n >= 2) & (below != 0), (n * sxy - sx * sy) / below).otherwise(0.0)
    mean = F.abs(sy / n)
    return F.when(mean > 0, slope / mean).otherwise(slope)


def lifecycle(metrics: DataFrame) -> DataFrame:
    """Adds stage and stage_confidence by the trends of the last 3 rows of each theme."""
    by = W.partitionBy("theme_id").orderBy("day")
    rows = metrics.withColumn("_row", F.row_number().over(by).cast("double"))
    last = by.rowsBetween(-(LIFECYCLE_ROWS - 1), 0)
    rows = rows.withColumn("_count", F.col("document_count").cast("double"))
    rows = rows.withColumns({"_v": F.coalesce(relative_trend("velocity", last), F.lit(0.0)), "_d": relative_trend("_count", last)})
    few = F.col("_row") < LIFECYCLE_ROWS
    stage = F.when(few, "emerging").when((F.col("document_count") < EMERGING_DOCS) & (F.col("_v") > 0), "emerging").when((F.col("_v") > ACCELERATING) & (F.col("_d") > 0), "accelerating").when(F.col("_v") < FADING, "fading").otherwise("mature")
    return rows.withColumn("stage", stage).withColumn("stage_confidence", F.when(few, 0.5).otherwise(F.when(F.col("stage") == "mature", 0.7).otherwise(F.least(F.lit(1.0), F.abs(F.col("_v")))))).drop("_row", "_count", "_v", "_d")


def lifecycle_transitions(staged: DataFrame) -> DataFrame:
    """Rows whose stage differs from the theme's row before, with from_stage and alertable."""
    before = F.lag("stage").over(W.partitionBy("theme_id").orderBy("day"))
    pairs = [(F.col("from_stage") == a) & (F.col("stage") == b) for a, b in ALERTABLE]
    alert = reduce(lambda a, b: a | b, pairs)
    return staged.withColumn("from_stage", before).filter("from_stage is not null and from_stage <> stage").withColumn("alertable", alert)


def theme_score(z: Column, compellingness: Column, stage: Column, propagation: Column, strategy: str = "swing") -> Column:
    a, b = STRATEGIES[strategy]
    bonus = F.least(F.greatest(F.coalesce(propagation, F.lit(0.0)), F.lit(0.0)), F.lit(0.5))
    return F.pow(F.greatest(F.coalesce(z, F.lit(0.0)) + 2, F.lit(0.0)), F.lit(a)) * F.pow(F.greatest(F.coalesce(compellingness, F.lit(DEFAULT_COMPELLINGNESS)), F.lit(0.0)), F.lit(b)) * lookup(stage, STAGE_FACTORS, DEFAULT_STAGE_FACTOR) * (1 + bonus)


def rank_themes(scored: DataFrame, by: list[str]) -> DataFrame:
    """Adds position and tier inside ``by`` to rows with score, volume_zscore, stage; low scores are dropped first."""
    rows = scored.filter(F.col("score") >= SCORE_MIN)
    group = W.partitionBy(*by)
    n = F.count("*").over(group)
    position = F.row_number().over(group.orderBy(F.desc("score"), "theme_id"))
    gate = (F.col("volume_zscore") >= TIER_1_Z) | (F.col("stage") == "accelerating")
    tier = F.when(F.col("position") <= F.greatest(F.lit(1), F.ceil(n * TIER_1)), F.when(F.coalesce(gate, F.lit(False)), 1).otherwise(2)).when(F.col("position") <= F.greatest(F.lit(1), F.ceil(n * TIER_2)), 2).otherwise(3)
    return rows.withColumn("position", position).withColumn("tier", tier)


def metric_alerts(daily: DataFrame) -> DataFrame:
    """theme_id, day, trigger, severity: sentiment velocity, extreme sentiment, volume surge; one row for each trigger that fires."""
    before = F.lag("bullish_ratio").over(W.partitionBy("theme_id").orderBy("day"))
    change = F.abs(F.col("bullish_ratio") - before)
    moved = F.when(change >= 0.6, "critical").when(change >= 0.3, "warning")
    extreme = F.when((F.col("bullish_ratio") > 0.85) | (F.col("bullish_ratio") < 0.15), "warning")
    surge = F.when(F.col("volume_zscore") >= 4, "critical").when(F.col("volume_zscore") >= 3, "warning")
    each = [F.struct(F.lit(name).alias("trigger"), sev.alias("severity")) for name, sev in (("sentiment_velocity", moved), ("extreme_sentiment", extreme), ("volume_surge", surge))]
    return daily.withColumn("_t", F.array(*each)).select("theme_id", "day", F.inline("_t")).filter("severity is not null")


def rate_limited(alerts: DataFrame, caps: dict[str, int], order: list[str]) -> DataFrame:
    """The first alerts of each day and severity, up to the severity's cap; severities without a cap pass.

    Each of SPREAD parts of a day first keeps its own first ones, so the last count sees SPREAD times the cap.
    """
    cap = lookup(F.col("severity"), caps, None)
    capped = alerts.filter(cap.isNotNull()).withColumn("_at", F.pmod(F.xxhash64(*order), F.lit(SPREAD)))
    for by in (["day", "severity", "_at"], ["day", "severity"]):
        capped = capped.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap)
    return capped.select(*alerts.columns).unionByName(alerts.filter(cap.isNull()))


def suppressed_repeats(alerts: DataFrame, hours: float = 4.0) -> DataFrame:
    """Alerts (subject, trigger, ts) kept greedily: each kept one silences its (subject, trigger) for ``hours``.

    The rule is sequential, but its state is one time stamp: a (subject, trigger)'s alerts
    come sorted and pass one by one, and no task holds more than a batch of them.
    """
    gap = int(hours * 3_600_000_000)

    def run(batches):
        key, last = None, None
        for b in batches:
            keep = []
            for s, t, at in zip(*(b.column(c).to_pylist() for c in ("subject", "trigger", "at")), strict=True):
                if (s, t) != key:
                    key, last = (s, t), None
                keep.append(at is not None and (last is None or at - last >= gap))
                last = at if keep[-1] else last
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = alerts.select("subject", "trigger", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    kept = rows.repartition("subject", "trigger").sortWithinPartitions("subject", "trigger", "at").mapInArrow(run, rows.schema)
    return kept.select("subject", "trigger", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))


def new_themes(now: DataFrame, before: DataFrame) -> DataFrame:
    """An info alert (theme_id, severity, title, message) for each theme (theme_id, theme_name) that wasn't there before."""
    rows = now.join(before.select("theme_id"), "theme_id", "left_anti")
    return rows.select("theme_id", F.lit("info").alias("severity"), F.concat(F.lit("New theme: "), "theme_name").alias("title"), F.concat(F.lit("New theme '"), "theme_name", F.lit("' detected from unassigned documents")).alias("message"))


def propagated_impacts(impacts: DataFrame, threshold: float) -> DataFrame:
    """Alerts of impacts (source_theme, target, impact, depth) of the threshold or more; critical at twice."""
    size, way = F.abs("impact"), F.when(F.col("impact") < 0, "negative").otherwise("positive")
    rows = impacts.filter(size >= threshold).withColumns({"severity": F.when(size >= 2 * threshold, "critical").otherwise("warning"), "direction": way})
    hops = F.concat(F.col("depth").cast("string"), F.when(F.col("depth") == 1, " hop away)").otherwise(" hops away)"))
    return rows.withColumn("message", F.concat(F.lit("Sentiment change in '"), "source_theme", F.lit("' propagated "), "direction", F.lit(" impact of "), F.format_string("%+.3f", "impact"), F.lit(" to "), "target", F.lit(" ("), hops))
