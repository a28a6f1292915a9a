"""Queries on timed documents: theme metrics, sentiment, narrative signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import narrative as N, sentiment as E, themes as T
from .bind import SIGNALS, signals
from .registry import query

AT = "2024-01-30 00:00:00"
_WEIGHT = "CASE platform WHEN 'twitter' THEN 1.0 WHEN 'reddit' THEN 5.0 WHEN 'news' THEN 20.0 WHEN 'substack' THEN 100.0 ELSE 1.0 END"
_AGE = "(epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY) - epoch_us(ts)) / 86400000000.0"
DAILY = f"""{SIGNALS},
seen AS (SELECT *, CAST(ts AS DATE) AS own, CAST(unnest(generate_series(CAST(CAST(ts AS DATE) AS TIMESTAMP), CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM signals),
daily AS (SELECT theme_id, day, sum({_WEIGHT} * exp(-0.3 * {_AGE}) * CASE WHEN authority > 0 THEN authority ELSE 0.1 END) AS weighted_volume, count(*) FILTER (own = day) AS document_count FROM seen WHERE {_AGE} <= 7 GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN count(weighted_volume) OVER w < 7 THEN NULL WHEN stddev_pop(weighted_volume) OVER w < 1e-12 THEN 0.0 ELSE (weighted_volume - avg(weighted_volume) OVER w) / stddev_pop(weighted_volume) OVER w END AS volume_zscore FROM daily WINDOW w AS (PARTITION BY theme_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
_EMA = "list_reduce(zs, lambda acc, v: {a} * v + (1 - {a}) * acc)"
VELOCITY = f"""{DAILY},
zl AS (SELECT *, list_filter(list(volume_zscore) OVER (PARTITION BY theme_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS zs FROM z),
v AS (SELECT theme_id, day, weighted_volume, document_count, volume_zscore, CASE WHEN len(zs) >= 7 THEN {_EMA.format(a=0.5)} - {_EMA.format(a=0.25)} END AS velocity FROM zl),
va AS (SELECT *, velocity - lag(velocity) OVER (PARTITION BY theme_id ORDER BY day) AS acceleration FROM v)"""


def _day():
    return F.col("day").cast("string").alias("day")


def _trend(v):
    return f"""CASE WHEN abs(sum({v}) OVER l / count({v}) OVER l) > 0 THEN {_slope(v)} / abs(sum({v}) OVER l / count({v}) OVER l) ELSE {_slope(v)} END"""


def _slope(v):
    n, sx, sy = f"count({v}) OVER l", f"sum(CASE WHEN {v} IS NOT NULL THEN r END) OVER l", f"sum({v}) OVER l"
    sxx, sxy = f"sum(CASE WHEN {v} IS NOT NULL THEN r * r END) OVER l", f"sum(r * {v}) OVER l"
    return f"CASE WHEN {n} >= 2 AND {n} * {sxx} - {sx} * {sx} <> 0 THEN ({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) ELSE 0.0 END"


STAGED = f"""{VELOCITY},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY theme_id ORDER BY day) AS DOUBLE) AS r, CAST(document_count AS DOUBLE) AS c FROM va),
trends AS (SELECT *, coalesce({_trend("velocity")}, 0.0) AS tv, {_trend("c")} AS td FROM numbered WINDOW l AS (PARTITION BY theme_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
staged AS (SELECT *, CASE WHEN r < 3 THEN 'emerging' WHEN document_count < 50 AND tv > 0 THEN 'emerging' WHEN tv > 0.5 AND td > 0 THEN 'accelerating' WHEN tv < -0.3 THEN 'fading' ELSE 'mature' END AS stage FROM trends)"""
SCORE = "power(greatest(coalesce(volume_zscore, 0) + 2, 0), 0.6) * power(5.0, 0.4) * CASE stage WHEN 'emerging' THEN 1.5 WHEN 'accelerating' THEN 1.2 WHEN 'mature' THEN 0.8 WHEN 'fading' THEN 0.3 ELSE 0.8 END"


def _metrics(spark, d):
    return T.velocities(T.volume_zscores(T.daily_volumes(signals(spark, d))))


@query(f"WITH {DAILY} SELECT theme_id, CAST(day AS VARCHAR) AS day, round(weighted_volume, 4) AS weighted_volume, document_count FROM daily")
def theme_volume_daily(spark, d):
    return T.daily_volumes(signals(spark, d)).select("theme_id", _day(), F.round("weighted_volume", 4).alias("weighted_volume"), "document_count")


@query(f"WITH {VELOCITY} SELECT theme_id, CAST(day AS VARCHAR) AS day, round(volume_zscore, 4) AS volume_zscore, round(velocity, 4) AS velocity, round(acceleration, 4) AS acceleration, CASE WHEN volume_zscore >= 3 THEN 'surge' WHEN volume_zscore <= -2 THEN 'collapse' END AS anomaly FROM va")
def theme_velocity(spark, d):
    return _metrics(spark, d).select("theme_id", _day(), *[F.round(c, 4).alias(c) for c in ("volume_zscore", "velocity", "acceleration")], T.volume_anomaly(F.col("volume_zscore")).alias("anomaly"))


@query(f"WITH {STAGED} SELECT theme_id, CAST(day AS VARCHAR) AS day, stage, round(CASE WHEN r < 3 THEN 0.5 WHEN stage = 'mature' THEN 0.7 ELSE least(1.0, abs(tv)) END, 4) AS stage_confidence FROM staged")
def theme_lifecycle(spark, d):
    return T.lifecycle(_metrics(spark, d)).select("theme_id", _day(), "stage", F.round("stage_confidence", 4).alias("stage_confidence"))


@query(f"WITH {STAGED} SELECT theme_id, CAST(day AS VARCHAR) AS day, from_stage, stage, (from_stage, stage) IN (('accelerating','fading'),('accelerating','mature'),('emerging','accelerating'),('emerging','fading'),('mature','fading')) AS alertable FROM (SELECT *, lag(stage) OVER (PARTITION BY theme_id ORDER BY day) AS from_stage FROM staged) WHERE from_stage IS NOT NULL AND from_stage <> stage")
def theme_transitions(spark, d):
    return T.lifecycle_transitions(T.lifecycle(_metrics(spark, d))).select("theme_id", _day(), "from_stage", "stage", "alertable")


@query(f"""WITH {STAGED}, s AS (SELECT *, {SCORE} AS score FROM staged),
k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, theme_id) AS position, count(*) OVER (PARTITION BY day) AS n FROM s WHERE score >= 0.1)
SELECT CAST(day AS VARCHAR) AS day, theme_id, round(score, 4) AS score, position, CASE WHEN position <= greatest(1, ceil(n * 0.05)) THEN CASE WHEN coalesce(volume_zscore >= 2 OR stage = 'accelerating', FALSE) THEN 1 ELSE 2 END WHEN position <= greatest(1, ceil(n * 0.2)) THEN 2 ELSE 3 END AS tier FROM k""")
def theme_ranking(spark, d):
    staged = T.lifecycle(_metrics(spark, d))
    scored = staged.withColumn("score", T.theme_score(F.col("volume_zscore"), F.lit(None).cast("double"), F.col("stage"), F.lit(0.0)))
    return T.rank_themes(scored, ["day"]).select(_day(), "theme_id", F.round("score", 4).alias("score"), "position", "tier")


_RATIO = "avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END)"
ALERTS = f"""{DAILY}, ratio AS (SELECT theme_id, CAST(ts AS DATE) AS day, {_RATIO} AS bullish_ratio FROM signals GROUP BY 1, 2),
m AS (SELECT z.theme_id, z.day, volume_zscore, bullish_ratio, abs(bullish_ratio - lag(bullish_ratio) OVER (PARTITION BY z.theme_id ORDER BY z.day)) AS change FROM z JOIN ratio ON z.theme_id = ratio.theme_id AND z.day = ratio.day),
alerts AS (SELECT * FROM (SELECT theme_id, day, 'sentiment_velocity' AS trigger, CASE WHEN change >= 0.6 THEN 'critical' WHEN change >= 0.3 THEN 'warning' END AS severity FROM m
 UNION ALL SELECT theme_id, day, 'extreme_sentiment', CASE WHEN bullish_ratio > 0.85 OR bullish_ratio < 0.15 THEN 'warning' END FROM m
 UNION ALL SELECT theme_id, day, 'volume_surge', CASE WHEN volume_zscore >= 4 THEN 'critical' WHEN volume_zscore >= 3 THEN 'warning' END FROM m) WHERE severity IS NOT NULL)"""


def _alerts(spark, d):
    docs = signals(spark, d)
    ratio = docs.groupBy("theme_id", F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("label") == "positive", 1.0).otherwise(0.0)).alias("bullish_ratio"))
    return T.metric_alerts(T.volume_zscores(T.daily_volumes(docs)).join(ratio, ["theme_id", "day"]))


@query(f"WITH {ALERTS} SELECT theme_id, CAST(day AS VARCHAR) AS day, trigger, severity FROM alerts")
def daily_alerts(spark, d):
    return _alerts(spark, d).select("theme_id", _day(), "trigger", "severity")


@query(f"WITH {ALERTS} SELECT theme_id, CAST(day AS VARCHAR) AS day, trigger, severity FROM (SELECT *, row_number() OVER (PARTITION BY day, severity ORDER BY theme_id, trigger) AS n FROM alerts) WHERE n <= CASE severity WHEN 'warning' THEN 2 WHEN 'critical' THEN 1 END")
def alert_rate_limit(spark, d):
    return T.rate_limited(_alerts(spark, d), {"warning": 2, "critical": 1}, ["theme_id", "trigger"]).select("theme_id", _day(), "trigger", "severity")


@query(f"""WITH RECURSIVE {SIGNALS}, a AS (SELECT entity AS subject, label AS trigger, ts, row_number() OVER (PARTITION BY entity, label ORDER BY ts, doc_id) AS n FROM signals),
k AS (SELECT subject, trigger, ts, n FROM a WHERE n = 1 UNION ALL SELECT subject, trigger, ts, n FROM (SELECT a.subject, a.trigger, a.ts, a.n, row_number() OVER (PARTITION BY a.subject, a.trigger ORDER BY a.n) AS p FROM k JOIN a ON a.subject = k.subject AND a.trigger = k.trigger AND a.n > k.n AND a.ts >= k.ts + INTERVAL 4 HOUR) WHERE p = 1)
SELECT subject, trigger, ts FROM k""")
def alert_suppression(spark, d):
    return T.suppressed_repeats(signals(spark, d).select(F.col("entity").alias("subject"), F.col("label").alias("trigger"), "ts"))


_DAYS = f"(epoch_us(TIMESTAMP '{AT}') - epoch_us(ts)) / 86400000000.0"
_W = f"exp(-0.3 * greatest({_DAYS}, 0)) * (1 + 0.3 * coalesce(authority, 0)) * (1 + 0.2 * confidence)"


@query(f"""WITH {SIGNALS}, r AS (SELECT *, {_W} AS w, CAST(ts AS DATE) AS day FROM signals WHERE {_DAYS} BETWEEN 0 AND 7),
m AS (SELECT theme_id, sum(CASE WHEN label = 'positive' THEN w ELSE 0 END) / sum(w) AS b, sum(CASE WHEN label = 'negative' THEN w ELSE 0 END) / sum(w) AS n, sum(CASE WHEN label = 'neutral' THEN w ELSE 0 END) / sum(w) AS u, sum(w * confidence) / sum(w) AS c, avg(authority) AS a, count(*) AS k FROM r GROUP BY 1),
y AS (SELECT theme_id, date_diff('day', DATE '2000-01-01', day) AS x, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS y FROM r GROUP BY 1, 2),
s AS (SELECT theme_id, CASE WHEN count(*) >= 2 THEN regr_slope(y, x) END AS v FROM y GROUP BY 1)
SELECT theme_id, round(b, 4) AS bullish_ratio, round(n, 4) AS bearish_ratio, round(u, 4) AS neutral_ratio, round(c, 4) AS avg_confidence, round(a, 8) AS avg_authority, k AS document_count, round(v, 4) AS sentiment_velocity, CASE WHEN b >= 0.85 THEN 'extreme_bullish' WHEN b <= 0.15 THEN 'extreme_bearish' END AS extreme FROM m JOIN s USING (theme_id)""")
def theme_sentiment(spark, d):
    out = E.theme_sentiment(signals(spark, d), F.lit(AT).cast("timestamp_ntz"))
    return out.select("theme_id", *[F.round(c, 4).alias(c) for c in ("bullish_ratio", "bearish_ratio", "neutral_ratio", "avg_confidence")], F.round("avg_authority", 8).alias("avg_authority"), "document_count", F.round("sentiment_velocity", 4).alias("sentiment_velocity"), "extreme")


@query(f"""WITH {SIGNALS}, r AS (SELECT *, {_W} AS w FROM signals), s AS (SELECT theme_id, doc_id, CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END * w / sum(w) OVER (PARTITION BY theme_id) AS share FROM r)
SELECT theme_id, doc_id, rank, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY abs(share) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def sentiment_attribution(spark, d):
    return E.attributed(signals(spark, d), F.lit(AT).cast("timestamp_ntz"), 5).select("theme_id", "doc_id", "rank", F.round("share", 6).alias("share"))


BUCKETS = f"""{SIGNALS}, g AS (SELECT *, CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS s, coalesce(authority, 0) >= 0.5 AS high FROM signals),
buckets AS (SELECT theme_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, count(*) AS doc_count, sum(s * confidence) AS sentiment_sum, sum(confidence) AS sentiment_weight, sum(CASE WHEN high THEN s * confidence ELSE 0 END) AS high_authority_sentiment_sum, sum(CASE WHEN high THEN confidence ELSE 0 END) AS high_authority_weight, count(*) FILTER (high) AS high_authority_doc_count FROM g GROUP BY 1, 2)"""
_BUCKET_COLUMNS = "round(sentiment_sum, 4) AS sentiment_sum, round(sentiment_weight, 4) AS sentiment_weight, round(high_authority_sentiment_sum, 4) AS high_authority_sentiment_sum, round(high_authority_weight, 4) AS high_authority_weight"
NARRATIVE_BUCKETS_SQL = f"WITH {BUCKETS} SELECT theme_id, bucket_start, doc_count, {_BUCKET_COLUMNS}, high_authority_doc_count FROM buckets"


def bucket_result(df):
    return df.select("theme_id", F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "doc_count", *[F.round(c, 4).alias(c) for c in ("sentiment_sum", "sentiment_weight", "high_authority_sentiment_sum", "high_authority_weight")], "high_authority_doc_count")


@query(NARRATIVE_BUCKETS_SQL)
def narrative_buckets(spark, d):
    return bucket_result(N.buckets(signals(spark, d), "theme_id"))


_MIN = f"(epoch_us(TIMESTAMP '{AT}') - epoch_us(bucket_start)) / 60000000.0"


@query(f"""WITH {BUCKETS}, a AS (SELECT *, {_MIN} AS age FROM buckets),
r AS (SELECT theme_id, sum(doc_count) AS total_docs, coalesce(sum(doc_count) FILTER (age BETWEEN 0 AND 30), 0) AS recent_docs, coalesce(avg(doc_count * 12.0) FILTER (age > 30 AND age <= 360), 0.0) AS base_rate, stddev_pop(doc_count * 12.0) FILTER (age > 30 AND age <= 360) AS spread, count(*) FILTER (age > 30 AND age <= 360) AS n FROM a GROUP BY 1),
z AS (SELECT *, recent_docs * 2.0 AS rate, CASE WHEN n > 1 AND spread > 1e-9 THEN (recent_docs * 2.0 - base_rate) / spread ELSE 0.0 END AS z, CASE WHEN base_rate > 0 THEN recent_docs * 2.0 / base_rate ELSE 0.0 END AS uplift FROM r)
SELECT theme_id, CAST(recent_docs AS BIGINT) AS recent_docs, CAST(rate AS DOUBLE) AS rate_per_hour, round(base_rate, 4) AS base_rate, round(z, 4) AS z, round(uplift, 4) AS uplift, total_docs >= 8 AND rate >= 6 AND (z >= 3 OR uplift >= 2.5) AS triggered FROM z""")
def narrative_surge(spark, d):
    out = N.surges(N.buckets(signals(spark, d), "theme_id"), F.lit(AT).cast("timestamp_ntz"), "theme_id")
    return out.select("theme_id", "recent_docs", "rate_per_hour", *[F.round(c, 4).alias(c) for c in ("base_rate", "z", "uplift")], "triggered")


@query(f"""WITH {SIGNALS}, f AS (SELECT entity, platform, min(ts) AS seen FROM signals GROUP BY 1, 2), l AS (SELECT entity, list_sort(list(seen)) AS seen FROM f GROUP BY 1)
SELECT entity, len(seen)::BIGINT AS platforms, round((epoch_us(seen[3]) - epoch_us(seen[1])) / 3600000000.0, 4) AS hours, coalesce((epoch_us(seen[3]) - epoch_us(seen[1])) / 3600000000.0 <= 6, FALSE) AS triggered FROM l""")
def cross_platform_breakout(spark, d):
    return N.breakouts(signals(spark, d), "entity").select("entity", "platforms", F.round("hours", 4).alias("hours"), "triggered")


_S = "CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END"


@query(f"""WITH {SIGNALS}, m AS (SELECT theme_id, sum({_S} * confidence) FILTER (coalesce(authority, 0) >= 0.5) / sum(confidence) FILTER (coalesce(authority, 0) >= 0.5) AS h, sum({_S} * confidence) FILTER (coalesce(authority, 0) < 0.5) / sum(confidence) FILTER (coalesce(authority, 0) < 0.5) AS l, count(*) FILTER (coalesce(authority, 0) >= 0.5) AS hd, count(*) FILTER (coalesce(authority, 0) < 0.5) AS ld FROM signals GROUP BY 1)
SELECT theme_id, round(h, 4) AS high_sentiment, round(l, 4) AS low_sentiment, round(abs(h - l), 4) AS gap, coalesce(hd >= 3 AND ld >= 3 AND abs(h - l) >= 0.45, FALSE) AS triggered FROM m""")
def authority_divergence(spark, d):
    return N.authority_divergence(signals(spark, d), "theme_id").select("theme_id", *[F.round(c, 4).alias(c) for c in ("high_sentiment", "low_sentiment", "gap")], "triggered")


_H = f"(epoch_us(TIMESTAMP '{AT}') - epoch_us(ts)) / 3600000000.0"


@query(f"""WITH {SIGNALS}, a AS (SELECT *, {_H} >= 0 AND {_H} < 12 AS new, {_H} >= 12 AND {_H} < 24 AS old, {_S} AS s FROM signals),
m AS (SELECT theme_id, count(*) FILTER (new) AS nd, count(*) FILTER (old) AS od, sum(s * confidence) FILTER (new) / sum(confidence) FILTER (new) AS n, sum(s * confidence) FILTER (old) / sum(confidence) FILTER (old) AS o, avg(confidence) FILTER (new) AS c FROM a GROUP BY 1)
SELECT theme_id, nd AS recent_docs, od AS prior_docs, round(n, 4) AS recent, round(o, 4) AS prior, coalesce(nd >= 6 AND od >= 6 AND ((o < 0 AND n >= 0) OR (o > 0 AND n <= 0)) AND abs(n - o) >= 0.35 AND c >= 0.7, FALSE) AS triggered FROM m""")
def sentiment_regime_shift(spark, d):
    return N.regime_shifts(signals(spark, d), F.lit(AT).cast("timestamp_ntz"), "theme_id").select("theme_id", "recent_docs", "prior_docs", F.round("recent", 4).alias("recent"), F.round("prior", 4).alias("prior"), "triggered")


@query(f"""WITH {SIGNALS}, n AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 24 * 3600000000, TRUE) THEN 1 ELSE 0 END AS new FROM signals WINDOW w AS (PARTITION BY entity ORDER BY ts, doc_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts, doc_id) AS run FROM n)
SELECT entity, run::BIGINT AS run, min(ts) AS started_at, max(ts) AS last_document_at, count(*) AS doc_count FROM s GROUP BY 1, 2""")
def session_runs(spark, d):
    return N.sessions(signals(spark, d), "entity", 24.0)


_COMPONENTS = f"""{SIGNALS}, r AS (SELECT entity, count(*) AS docs, count(DISTINCT platform) AS platforms, avg({_S}) AS sentiment, avg(authority) AS authority, avg(CASE WHEN coalesce(authority, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS high_share, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS span, (epoch_us(TIMESTAMP '{AT}') - epoch_us(max(ts))) / 3600000000.0 AS quiet, (epoch_us(TIMESTAMP '{AT}') - epoch_us(min(ts))) / 3600000000.0 AS age FROM signals WHERE ts <= TIMESTAMP '{AT}' GROUP BY 1)"""
_CLAMP = "least(1.0, greatest(0.0, {}))"


@query(f"""WITH {_COMPONENTS}, c AS (SELECT entity, 0.5 * {_CLAMP.format('docs / greatest(span, 1.0) / 60.0')} + 0.2 * {_CLAMP.format('docs / 50.0')} AS attention,
 0.4 * {_CLAMP.format('platforms / 5.0')} + 0.35 * {_CLAMP.format('platforms / 4.0')} + 0.25 * CASE WHEN span > 0 THEN {_CLAMP.format('1.0 - span / 6.0')} ELSE 0.0 END AS corroboration,
 0.45 * {_CLAMP.format('coalesce(authority, 0)')} + 0.3 * {_CLAMP.format('abs(sentiment)')} + 0.25 * {_CLAMP.format('high_share')} AS confirmation,
 {_CLAMP.format('0.5 * exp(-0.02 * greatest(quiet, 0)) + 0.25 * least(1.0, ln(1 + age) / ln(49.0)) + 0.25 * least(1.0, exp(-0.02 * greatest(quiet, 0)) * (1 - 0.3 * least(1.0, ln(1 + age) / ln(49.0))))')} AS novelty FROM r)
SELECT entity, round(attention, 8) AS attention, round(corroboration, 8) AS corroboration, round(confirmation, 8) AS confirmation, round(novelty, 8) AS novelty_persistence, round(100 * (0.30 * attention + 0.25 * corroboration + 0.25 * confirmation + 0.20 * novelty), 6) AS composite FROM c""")
def narrative_components(spark, d):
    at = F.lit(AT).cast("timestamp_ntz")
    hours = lambda a, b: T.days_between(a, b) * 24
    runs = signals(spark, d).filter(F.col("ts") <= at).groupBy("entity").agg(F.count("*").alias("docs"), F.countDistinct("platform").alias("platforms"), F.avg(N.sign_of(F.col("label"))).alias("sentiment"), F.avg("authority").alias("authority"), F.avg(F.when(F.coalesce(F.col("authority"), F.lit(0.0)) >= 0.5, 1.0).otherwise(0.0)).alias("high_share"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    runs = runs.withColumns({"span": hours(F.col("last"), F.col("first")), "quiet": hours(at, F.col("last")), "age": hours(at, F.col("first"))})
    out = runs.withColumns(
        {
            "attention": S.attention(F.col("docs") / F.greatest(F.col("span"), F.lit(1.0)), F.lit(0.0), F.col("docs")),
            "corroboration": S.corroboration(F.col("platforms"), F.col("platforms"), F.col("span")),
            "confirmation": S.confirmation(F.col("sentiment"), F.col("authority"), F.col("high_share")),
            "novelty_persistence": S.novelty_persistence(F.col("quiet"), F.col("age")),
        }
    )
    return out.select("entity", *[F.round(c, 8).alias(c) for c in ("attention", "corroboration", "confirmation", "novelty_persistence")], F.round(S.narrative_composite(*[F.col(c) for c in ("attention", "corroboration", "confirmation", "novelty_persistence")]), 6).alias("composite"))
