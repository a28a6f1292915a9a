"""Queries that read the engine's file formats; their lines are spelled from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import documents as D, files as S
from .bind import table
from .registry import query


def _json(*pairs):
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


@query("SELECT 'twitter_' || CAST(event_id AS VARCHAR) AS id, 'https://x.com/i/status/' || CAST(event_id AS VARCHAR) AS url, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at, event_type AS author_name, event_id % 3 = 0 AS verified, 'in my opinion event ' || event_type || ' due diligence' AS content, CAST(floor(value) AS BIGINT) AS likes, 0::BIGINT AS shares FROM events WHERE event_id % 50 <> 0")
def read_posts(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("imo  event "), F.col("event_type"), F.lit(" DD\n")))
    author = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, True).alias("verified"))
    line = _json(("id", F.col("event_id").cast("string")), ("text", text), ("created_at", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("author", author), ("metrics", F.struct(F.floor("value").cast("long").alias("likes"))))
    good, _ = D.posts(e.select(line.alias("value")))
    return good.select("id", "url", F.unix_seconds("timestamp").alias("at"), "author_name", F.col("author_verified").alias("verified"), "content", "engagement.likes", "engagement.shares")


@query(r"SELECT 'reddit_' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, trim(regexp_replace(role || ' ' || text, '[ \t\r\n]+', ' ', 'g')) AS content, role AS title, 1700000000 AS at, turn::BIGINT AS likes FROM conversations WHERE role <> 'system' AND length(trim(regexp_replace(role || ' ' || text, '[ \t\r\n]+', ' ', 'g'))) >= 10")
def read_threads(spark, d):
    c = table(spark, d, "conversations")
    line = _json(("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), ("title", F.col("role")), ("selftext", F.col("text")), ("created_utc", F.lit(1.7e9)), ("stickied", F.col("role") == "system"), ("permalink", F.lit("/r/x")), ("score", F.col("turn")))
    good, _ = D.threads(c.select(line.alias("value")))
    return good.select("id", "content", "title", F.unix_seconds("timestamp").cast("int").alias("at"), "engagement.likes")


@query("""WITH i AS (SELECT p_size, 'f' || CAST(p_partkey % 3 AS VARCHAR) AS feed, 'text ' || CAST(p_partkey AS VARCHAR) AS content FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY feed, content) AS n FROM i)
SELECT 'news_' || substr(sha256('https://x.com/' || CAST(p_size AS VARCHAR)), 1, 16) AS id, feed, 'https://x.com/' || CAST(p_size AS VARCHAR) AS url, content, 'a title' AS title, 1704189600 AS at, p_size % 2 = 0 AND false AS verified FROM r WHERE n = 1""")
def read_feeds(spark, d):
    p = table(spark, d, "part")
    item = F.concat(F.lit("<item><title> a  title</title><link>https://x.com/"), F.col("p_size").cast("string"), F.lit("</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;text "), F.col("p_partkey").cast("string"), F.lit("&lt;/p&gt;</description></item>"))
    good, _ = D.feed_items(p.select(item.alias("value"), F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("feed")))
    return good.select("id", F.col("author_id").alias("feed"), "url", "content", "title", F.unix_seconds("timestamp").cast("int").alias("at"), F.col("author_verified").alias("verified"))


@query("""SELECT 's' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate::DATE AS VARCHAR) AS trade_date, sum(l_quantity)::BIGINT AS short_volume, round(avg(CASE WHEN l_quantity > 0 THEN 0.5 END), 6) AS short_ratio, 'Q' AS market, count(*) AS n FROM lineitem WHERE l_linenumber % 7 <> 0 GROUP BY 1, 2
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, count(*) FROM lineitem WHERE l_linenumber % 7 = 0""")
def read_short_volume(spark, d):
    li = table(spark, d, "lineitem").withColumn("line", F.monotonically_increasing_id())
    text = F.concat_ws("|", F.date_format("l_shipdate", "yyyyMMdd"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string"), F.lit("0"), (F.col("l_quantity") * 2).cast("string"), F.lit("Q"))
    lines = li.select("line", F.when(F.col("l_linenumber") % 7 == 0, "broken|line").otherwise(text).alias("value"))
    head = spark.createDataFrame([(-1, "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market"), (1 << 60, "99")], "line long, value string")
    rows, bad = S.short_volume(lines.unionByName(head))
    good = rows.groupBy("symbol", F.col("trade_date").cast("string").alias("trade_date")).agg(F.sum("short_volume").cast("long").alias("short_volume"), F.round(F.avg("short_ratio").cast("double"), 6).alias("short_ratio"), F.max("market").alias("market"), F.count("*").alias("n"))
    rejected = bad.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("symbol"), *[F.lit(None).cast(t).alias(c) for c, t in (("trade_date", "string"), ("short_volume", "long"), ("short_ratio", "double"), ("market", "string"))], "n")
    return good.unionByName(rejected)


@query("""SELECT CAST(o_orderdate::DATE AS VARCHAR) AS settlement_date, 'C' || CAST(o_custkey AS VARCHAR) AS cusip, 'S' || CAST(o_orderkey AS VARCHAR) AS symbol, o_orderkey AS quantity, CASE WHEN o_orderkey % 4 > 0 THEN 2.5 END::DOUBLE AS price, CASE WHEN o_orderkey % 4 > 0 THEN 2.5 * o_orderkey END::DOUBLE AS notional FROM orders WHERE o_orderkey % 11 > 0""")
def read_fails_to_deliver(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    text = F.concat_ws("|", F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), k.cast("string")), k.cast("string"), F.lit("a name"), F.when(k % 4 == 0, ".").otherwise("2.5"))
    lines = o.select(F.monotonically_increasing_id().alias("line"), F.when(k % 11 == 0, "too|few").otherwise(text).alias("value"))
    head = spark.createDataFrame([(-1, "SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE"), (1 << 60, "Trailer record count 99")], "line long, value string")
    rows, _ = S.fails_to_deliver(lines.unionByName(head))
    return rows.select(F.col("settlement_date").cast("string").alias("settlement_date"), "cusip", "symbol", "quantity", F.col("price").cast("double").alias("price"), F.col("notional").cast("double").alias("notional"))


@query("SELECT count(*) AS expected FROM nation")
def read_trailer(spark, d):
    n = table(spark, d, "nation")
    lines = n.select(F.col("n_nationkey").cast("long").alias("line"), F.col("n_name").alias("value")).union(n.agg(F.lit(1 << 40).alias("line"), F.concat(F.lit("rows: "), F.count("*").cast("string")).alias("value")))
    return S.trailer_count(lines)


@query("SELECT p_partkey AS year, CASE p_size % 4 WHEN 0 THEN CAST(make_date(2024, 1 + p_size % 12, 1) AS VARCHAR) WHEN 1 THEN CAST(make_date(2024, 1 + 3 * (p_size % 3), 1) AS VARCHAR) END AS day FROM part")
def period_dates(spark, d):
    s = F.col("p_size")
    period = F.when(s % 4 == 0, F.concat(F.lit("M"), F.lpad((1 + s % 12).cast("string"), 2, "0"))).when(s % 4 == 1, F.concat(F.lit("Q0"), (1 + s % 3).cast("string"))).when(s % 4 == 2, "M13").otherwise("annual")
    return table(spark, d, "part").select(F.col("p_partkey").alias("year"), S.period_date(F.lit(2024), period).cast("string").alias("day"))


@query("SELECT unnest(['key', 'seg']) AS column, unnest([CAST(c_custkey AS VARCHAR), c_mktsegment]) AS cell FROM customer")
def read_array_table(spark, d):
    row = F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment"))
    lines = table(spark, d, "customer").groupBy(F.col("c_custkey") % 9).agg(F.to_json(F.concat(F.array(F.array(F.lit("key"), F.lit("seg"))), F.collect_list(row))).alias("value"))
    return S.array_table(lines).select("column", "cell")


@query("SELECT CAST(o_orderdate::DATE AS VARCHAR) AS date, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END::DOUBLE AS value FROM orders")
def read_csv_series(spark, d):
    o = table(spark, d, "orders")
    body = o.select((F.monotonically_increasing_id() + 10).alias("line"), F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "ND").otherwise(F.col("o_orderkey").cast("string"))).alias("value"))
    head = spark.createDataFrame([(1, "Series Description,x"), (2, "Unit:,y"), (3, "Time Period,Z")], "line long, value string")
    return S.csv_after_header(head.unionByName(body)).select("date", "value")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'rumor' WHEN 1 THEN 'guided' ELSE 'reported' END AS modality, CASE n_nationkey % 4 WHEN 0 THEN '2025-Q2' WHEN 1 THEN '2024-Q3' WHEN 2 THEN '2026-H1' END AS period, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1 END AS weight, CASE WHEN n_nationkey % 2 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS minutes FROM nation".replace("0.0 ELSE 0.5", "0.1 ELSE 0.5"))
def text_marks(spark, d):
    k = F.col("n_nationkey")
    modality = T.modality(F.when(k % 3 == 0, "will reportedly rise").when(k % 3 == 1, "expects more").otherwise("rose"))
    period = T.period_of(F.when(k % 4 == 0, "in Q2 2025").when(k % 4 == 1, "third quarter").when(k % 4 == 2, "H1 2026").otherwise("soon"), F.lit(2024))
    words = F.expr("repeat('word ', if(n_nationkey % 2 = 0, 20, 100))")
    return table(spark, d, "nation").select("n_nationkey", modality.alias("modality"), period.alias("period"), D.source_weight(F.when(k % 2 == 0, "https://www.WSJ.com/a").otherwise("https://a.b")).alias("weight"), D.read_minutes(words).alias("minutes"))


@query("SELECT o_custkey AS cik, o_orderstatus AS fact, CAST(o_orderdate::DATE AS VARCHAR) AS period_end, 'a' || CAST(o_orderkey AS VARCHAR) AS accession, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 9 <> 0")
def read_company_facts(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    obs = F.struct(day.alias("end"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("val"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("accn"), F.lit("10-Q").alias("form"), day.alias("filed"))
    per = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(obs).alias("l")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.struct(F.create_map(F.lit("USD"), F.col("l")).alias("units"))))).alias("m"))
    lines = per.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))).alias("value"))
    return S.company_facts(lines).select("cik", "fact", F.col("period_end").cast("string").alias("period_end"), "accession", F.round(F.col("value").cast("double"), 2).alias("value"))


@query("SELECT o_orderpriority AS factor_id, CAST(o_orderdate::DATE AS VARCHAR) AS observation_date, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 2) END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' END AS missing_reason FROM orders")
def read_factor_series(spark, d):
    o = table(spark, d, "orders")
    obs = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    lines = o.groupBy(F.col("o_orderpriority"), (F.col("o_orderkey") % 50).alias("k")).agg(F.to_json(F.struct(F.collect_list(obs).alias("observations"))).alias("value"))
    return S.series_json(lines, F.col("o_orderpriority")).select("factor_id", F.col("observation_date").cast("string").alias("observation_date"), F.round("value", 2).alias("value"), "missing_reason")


@query("SELECT 'T' || CAST(s_suppkey AS VARCHAR) AS ticker, CASE s_suppkey % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'NYSE Arca' END AS exchange, s_name AS name, s_suppkey % 4 = 0 AS is_etf, s_suppkey % 10 <> 0 AS is_active FROM supplier")
def read_symbol_directories(spark, d):
    s = table(spark, d, "supplier").withColumn("line", F.col("s_suppkey"))
    yes, etf = (F.when(F.col("s_suppkey") % n == 0, "Y").otherwise("N") for n in (10, 4))
    ticker = F.concat(F.lit("T"), F.col("line").cast("string"))
    listed = s.filter("s_suppkey % 3 = 0").select("line", F.concat_ws("|", ticker, "s_name", F.lit("Q"), yes, F.lit("N"), F.lit("100"), etf, F.lit("N")).alias("value"))
    other = s.filter("s_suppkey % 3 <> 0").select("line", F.concat_ws("|", ticker, "s_name", F.when(F.col("line") % 3 == 1, "N").otherwise("P"), F.lit("x"), etf, F.lit("100"), yes, F.lit("x")).alias("value"))
    return S.symbol_directory(listed, other)
