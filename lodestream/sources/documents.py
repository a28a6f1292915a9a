"""Document sources: every reader gives rows of one schema, and what can't be read as a quarantine frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T

POST = "id string, text string, created_at string, author_id string, author struct<name:string,followers:long,verified:boolean>, metrics struct<likes:long,shares:long,comments:long,views:long>"
THREAD = "id string, title string, selftext string, created_utc double, author string, score long, num_comments long, upvote_ratio double, stickied boolean, removed boolean, permalink string"
ITEM = "guid string, title string, link string, pubDate string, description string, author string"
# Fixed values
ABBREVIATIONS = {
    "LFG": "lets go",
    "HODL": "hold",
    "FOMO": "fear of missing out",
    "FUD": "fear uncertainty doubt",
    "DD": "due diligence",
    "IMO": "in my opinion",
    "IMHO": "in my humble opinion",
    "TLDR": "too long didnt read",
    "ATH": "all time high",
    "ATL": "all time low",
    "YOLO": "you only live once",
    "DCA": "dollar cost averaging",
}
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
SOURCE_WEIGHTS = [("wsj.com", 3), ("bloomberg.com", 3), ("reuters.com", 3), ("ft.com", 3), ("barrons.com", 3), ("cnbc.com", 2), ("yahoo.com", 2), ("seekingalpha.com", 2), ("marketwatch.com", 2), ("investors.com", 2)]
COLUMNS = ["id", "platform", "url", "timestamp", "author_id", "author_name", "author_followers", "author_verified", "content", "content_type", "title", "engagement", "urls_mentioned"]


def parsed_time(*columns: Column) -> Column:
    """The first column that any known format reads; formats without a zone are UTC."""
    text = [F.regexp_replace(F.regexp_replace(F.trim(c), "(GMT|UTC)$", "+0000"), "^[A-Za-z]{3}, *", "") for c in columns]
    return F.coalesce(*[F.expr("cast(null as timestamp)"), *[F.try_to_timestamp(c, F.lit(f)) for c in text for f in TIME_FORMATS]])


def expanded(text: Column) -> Column:
    return reduce(lambda t, kv: F.regexp_replace(t, rf"(?i)\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), text)


def without_markdown(text: Column) -> Column:
    steps = [(r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^>\s?", ""), (r"\*\*([^*]*)\*\*", "$1"), (r"\*([^*]*)\*", "$1"), (r"~~([^~]*)~~", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^\s*[-*]\s+", "")]
    return T.normalized(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


def engagement(likes: Column, shares: Column, comments: Column, views: Column, ratio: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return F.struct(zero(likes).alias("likes"), zero(shares).alias("shares"), zero(comments).alias("comments"), zero(views).alias("views"), ratio.cast("double").alias("upvote_ratio"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _split(rows: DataFrame, ok: Column, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(ok, F.lit(False))
    return rows.filter(good).withColumn("urls_mentioned", T.urls(F.col("content"))).select(*COLUMNS), rows.filter(~good).select(raw)


def posts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON posts (a column ``value``): documents and quarantined lines (no id, no text, no time)."""
    p = lines.withColumn("p", F.from_json("value", POST))
    rows = p.select(
        "value", F.concat(F.lit("twitter_"), F.col("p.id")).alias("id"), F.lit("twitter").alias("platform"), F.concat(F.lit("https://x.com/i/status/"), F.col("p.id")).alias("url"),
        parsed_time(F.col("p.created_at")).alias("timestamp"), F.col("p.author_id").alias("author_id"), F.col("p.author.name").alias("author_name"), F.col("p.author.followers").alias("author_followers"), F.coalesce("p.author.verified", F.lit(False)).alias("author_verified"),
        T.cleaned(expanded(F.col("p.text"))).alias("content"), F.lit("post").alias("content_type"), _none("string").alias("title"),
        engagement(F.col("p.metrics.likes"), F.col("p.metrics.shares"), F.col("p.metrics.comments"), F.col("p.metrics.views"), _none("double")).alias("engagement"),
    )
    return _split(rows, F.col("id").isNotNull() & (F.length("content") > 0) & F.col("timestamp").isNotNull())


def threads(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON forum threads; pinned, removed and under 10 characters are quarantined."""
    p = lines.withColumn("p", F.from_json("value", THREAD))
    body = without_markdown(F.concat_ws(" ", "p.title", "p.selftext"))
    rows = p.select(
        "value", "p", F.concat(F.lit("reddit_"), F.col("p.id")).alias("id"), F.lit("reddit").alias("platform"), F.concat(F.lit("https://reddit.com"), F.col("p.permalink")).alias("url"),
        F.timestamp_seconds("p.created_utc").alias("timestamp"), F.col("p.author").alias("author_id"), F.col("p.author").alias("author_name"), _none("long").alias("author_followers"), F.lit(False).alias("author_verified"),
        body.alias("content"), F.lit("thread").alias("content_type"), F.col("p.title").alias("title"), engagement(F.col("p.score"), _none("long"), F.col("p.num_comments"), _none("long"), F.col("p.upvote_ratio")).alias("engagement"),
    )
    hidden = F.coalesce("p.stickied", F.lit(False)) | F.coalesce("p.removed", F.lit(False))
    return _split(rows, F.col("id").isNotNull() & ~hidden & (F.length("content") >= 10))


def feed_items(items: DataFrame, platform: str = "news") -> tuple[DataFrame, DataFrame]:
    """XML items (columns ``value`` and ``feed``): articles, one a link over all feeds, the first by feed and time."""
    p = items.withColumn("p", F.from_xml("value", ITEM))
    rows = p.select(
        "value", F.concat(F.lit(f"{platform}_"), T.stable_hash(F.col("p.link"))).alias("id"), F.lit(platform).alias("platform"), F.col("p.link").alias("url"), parsed_time(F.col("p.pubDate")).alias("timestamp"),
        F.col("feed").alias("author_id"), F.coalesce("p.author", "feed").alias("author_name"), _none("long").alias("author_followers"), (source_weight(F.col("p.link")) >= 3).alias("author_verified"),
        T.html_text(F.col("p.description"), drop=()).alias("content"), F.lit("article").alias("content_type"), T.normalized(F.col("p.title")).alias("title"), engagement(*[_none("long")] * 4, _none("double")).alias("engagement"),
    )
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy("author_id", "timestamp", "value")))
    return _split(first, F.col("url").isNotNull() & F.col("timestamp").isNotNull() & (F.col("_n") == 1))


def read_minutes(content: Column) -> Column:
    return F.round(F.size(T.words(content)) / 200, 1)


def source_weight(url: Column) -> Column:
    return reduce(lambda acc, kv: F.when(F.lower(url).contains(kv[0]), kv[1]).otherwise(acc), reversed(SOURCE_WEIGHTS), F.lit(1))


def recent(documents: DataFrame, at: Column, days: int) -> DataFrame:
    return documents.filter(F.col("timestamp") >= at - F.make_dt_interval(days=F.lit(days)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, batch; the same for a stream by spark.readStream.text(path)."""
    return spark.read.text(path)


def synthetic(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n documents that depend on the seed alone."""
    h = F.xxhash64("id", F.lit(seed))
    return spark.range(n).select(F.concat(F.lit("mock_"), F.col("id").cast("string")).alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("twitter", "reddit", "news", "substack")]), (F.pmod(h, F.lit(4)) + 1).cast("int")).alias("platform"), F.concat(F.lit("document about $T"), F.pmod(h, F.lit(26)).cast("string")).alias("content"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("timestamp"))
