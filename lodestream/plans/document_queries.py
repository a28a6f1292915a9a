"""Queries on documents, pages, conversations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D, themes as T
from .bind import SIGNALS, signals, table
from .registry import query

AT = "2024-01-30 00:00:00"
_NORM = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))"
_WORDS = r"list_filter(string_split_regex(lower({}), '[ \t\r\n]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, substr(sha256({_NORM.format('text')}), 1, 16) AS short_hash, sha256({_NORM.format('text')} || chr(0) || source || chr(0) || lang) AS fingerprint, length({_NORM.format('text')}) AS n FROM documents")
def exact_fingerprint(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.stable_hash(X.normalized(F.col("text"))).alias("short_hash"), X.exact_fingerprint(F.col("text"), F.col("source"), F.col("lang")).alias("fingerprint"), F.length(X.normalized(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, copies FROM (SELECT doc_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY sha256({_NORM.format('text')})) AS copies FROM documents WINDOW w AS (PARTITION BY sha256({_NORM.format('text')}) ORDER BY doc_id)) WHERE n = 1")
def dedupe_exact(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(X.normalized(F.col("text")), 256).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(rf"""WITH w AS (SELECT doc_id, text, source, list_sort({_WORDS.format('text')}) AS ws FROM documents),
s AS (SELECT doc_id, text, source, len(ws) AS n, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(ws) AS x) GROUP BY x)), 0) AS best FROM w)
SELECT doc_id, CAST(round(least(1.0, CASE WHEN length(text) < 20 THEN 0.2 ELSE 0 END + CASE WHEN upper(text) = text AND lower(text) <> text AND length(text) > 20 THEN 0.15 ELSE 0 END + CASE WHEN best::DOUBLE / n > 0.3 AND n > 10 THEN 0.2 ELSE 0 END), 4) AS DOUBLE) AS spam_score FROM s""")
def spam_score(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.round(X.spam_score(F.col("text"), F.lit(0), F.col("source"), F.lit(None).cast("int"), F.lit(0), F.lit(False)), 4).alias("spam_score"))


_RAW = "CASE o_orderkey % 9 WHEN 0 THEN '$' || CAST(o_orderkey AS VARCHAR) || ' million' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '%' WHEN 2 THEN CAST(o_orderkey % 9 AS VARCHAR) || 'nm' WHEN 3 THEN '1,' || CAST(100 + o_orderkey % 900 AS VARCHAR) || ' units' WHEN 4 THEN CAST(o_orderkey % 50 AS VARCHAR) || ' weeks' WHEN 5 THEN 'next quarter' WHEN 6 THEN '$' || CAST(o_orderkey % 70 AS VARCHAR) || '.5b' WHEN 7 THEN ' 12k ' ELSE CAST(o_orderkey AS VARCHAR) END"


@query(rf"""WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders), p AS (SELECT o_orderkey, raw, regexp_extract(raw, '^\s*(\$)?\s*(\d[\d,]*(?:\.\d+)?)\s*(billion|million|thousand|nm|units?|weeks?|months?|days?|[bmk]|%)?\s*$', ['dollar', 'num', 'suffix'], 'i') AS m FROM r)
SELECT o_orderkey, raw, round(try_cast(replace(m.num, ',', '') AS DOUBLE) * CASE lower(m.suffix) WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END, 2) AS value,
 CASE WHEN m.num = '' THEN NULL WHEN m.dollar = '$' THEN 'USD' ELSE CASE lower(m.suffix) WHEN '%' THEN '%' WHEN 'nm' THEN 'nm' WHEN 'weeks' THEN 'weeks' WHEN 'week' THEN 'weeks' WHEN 'months' THEN 'months' WHEN 'days' THEN 'days' ELSE 'count' END END AS unit FROM p""")
def parse_quantity(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW.replace("AS VARCHAR", "AS STRING")).alias("raw")).withColumn("q", X.quantity(F.col("raw")))
    return rows.select("o_orderkey", "raw", F.round("q.value", 2).alias("value"), "q.unit")


@query(r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(1,234.5)' WHEN 1 THEN '$' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'N/A' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN 'abc' ELSE '--' END AS raw FROM customer)
SELECT c_custkey, CASE WHEN lower(trim(raw)) IN ('', '.', '-', '--', 'na', 'n/a', 'none', 'null', 'nan') THEN NULL ELSE try_cast(regexp_replace(regexp_replace(lower(trim(raw)), '[,$%]', '', 'g'), '^\((.*)\)$', '-\1') AS DOUBLE) END AS value FROM t""")
def parse_number(spark, d):
    raw = F.expr("CASE c_custkey % 6 WHEN 0 THEN '(1,234.5)' WHEN 1 THEN concat('$', c_custkey) WHEN 2 THEN 'N/A' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN 'abc' ELSE '--' END")
    return table(spark, d, "customer").select("c_custkey", X.number(raw).alias("value"))


@query(r"""WITH t AS (SELECT page_id, url, html FROM pages), c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g'), '(?is)<header[^>]*>.*?</header>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x, url FROM t)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS text_hash FROM c""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.sha2(X.html_text(F.col("html")), 256).alias("text_hash"))


@query("""SELECT doc_id, source, substr(text, 1, 300) AS preview FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 3000 AND coalesce(source, '') NOT IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING avg(n_chars) > 3000) ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10""")
def document_listing(spark, d):
    docs = table(spark, d, "documents")
    inactive = docs.filter("source is not null").groupBy("source").agg(F.avg("n_chars").alias("a")).filter("a > 3000").select("source")
    rows = D.filtered(docs, [F.col("lang") == "en", F.col("n_chars").between(200, 3000)], inactive)
    return D.page(rows, [F.desc("n_chars"), "doc_id"], 10, 50).select("doc_id", "source", F.substring("text", 1, 300).alias("preview"))


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY lang")
def document_count(spark, d):
    return D.filtered(table(spark, d, "documents"), [F.col("n_chars") > 500]).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, pos, n_chars FROM (VALUES (5, 0), (3, 1), (99, 2), (7, 3)) v(doc_id, pos) JOIN documents USING (doc_id)")
def documents_by_ids(spark, d):
    return D.in_order_of(table(spark, d, "documents"), [5, 3, 99, 7], "doc_id").select("doc_id", "pos", "n_chars")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), r AS (SELECT doc_id, (len(list_filter(ws, lambda x: x = 'the')) + len(list_filter(ws, lambda x: x = 'of'))) / sqrt(len(ws)::DOUBLE) AS rank FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'of'))
SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank DESC, doc_id LIMIT 25""")
def term_search(spark, d):
    return D.term_search(table(spark, d, "documents"), ["the", "of"], 25).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), t AS (SELECT doc_id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'les')) AS a, len(list_filter(ws, lambda x: x = 'pour')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)), 5) AS score FROM t, s WHERE a > 0 OR b > 0""")
def bm25_search(spark, d):
    return D.bm25(table(spark, d, "documents"), ["les", "pour"]).select("doc_id", F.round("score", 5).alias("score"))


@query("""WITH j AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT lang, grouping(lang) AS is_total, count(*) AS documents, round(avg(CASE WHEN labelled THEN 1.0 ELSE 0 END), 6) AS labelled_share, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END), 6) AS long_share FROM j GROUP BY ROLLUP (lang)""")
def doc_stats_grouping_sets(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left")
    out = D.coverage(docs, "lang", {"labelled": F.col("l").isNotNull(), "long": F.col("n_chars") > 1000})
    return out.select("lang", F.col("is_total").cast("long").alias("is_total"), "documents", F.round("labelled_share", 6).alias("labelled_share"), F.round("long_share", 6).alias("long_share"))


@query(f"WITH {SIGNALS} SELECT entity, count(*) AS mentions, count(DISTINCT doc_id) AS documents, min(ts) AS first_seen, max(ts) AS last_seen FROM signals GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 20")
def entity_counts(spark, d):
    return D.entity_counts(signals(spark, d), 20)


_H = f"(epoch_us(TIMESTAMP '{AT}') - epoch_us(ts)) / 3600000000.0"


@query(f"""WITH {SIGNALS}, r AS (SELECT entity, count(*) FILTER ({_H} <= 24) AS recent, count(*) FILTER ({_H} > 24 AND {_H} <= 168) AS baseline FROM signals WHERE {_H} >= 0 AND {_H} <= 192 GROUP BY 1)
SELECT entity, recent, baseline, spike FROM (SELECT *, round(CASE WHEN baseline = 0 THEN recent ELSE recent * 168.0 / (baseline * 24.0) END, 2) AS spike FROM r WHERE recent >= 2) ORDER BY spike DESC, recent DESC, entity LIMIT 20""")
def entity_trending(spark, d):
    return D.trending(signals(spark, d), F.lit(AT).cast("timestamp_ntz"), 24, 168, 20)


@query(f"""WITH {SIGNALS}, p AS (SELECT DISTINCT theme_id * 1000 + CAST(extract(day FROM ts) AS BIGINT) AS unit, entity FROM signals), m AS (SELECT unit FROM p WHERE entity = 'k7')
SELECT entity, count(*) AS together, round(count(*)::DOUBLE / (SELECT count(*) FROM m), 6) AS overlap_ratio FROM p WHERE entity <> 'k7' AND unit IN (SELECT unit FROM m) GROUP BY 1 HAVING count(*) >= 3""")
def entity_cooccurrence(spark, d):
    m = signals(spark, d).withColumn("unit", F.col("theme_id") * 1000 + F.dayofmonth("ts"))
    return D.cooccurring(m, "unit", "k7", 3).select("entity", "together", F.round("overlap_ratio", 6).alias("overlap_ratio"))


@query(f"""WITH {SIGNALS}, s AS (SELECT *, CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS v FROM signals), m AS (SELECT entity, avg(v) AS overall, avg(v) FILTER (ts >= TIMESTAMP '2024-01-23 00:00:00') AS recent, avg(v) FILTER (ts < TIMESTAMP '2024-01-23 00:00:00') AS before, count(*) FILTER (v > 0) AS positive FROM s GROUP BY 1)
SELECT entity, round(overall, 5) AS overall, round(recent, 5) AS recent, round(before, 5) AS before, positive, CASE WHEN recent - before > 0.05 THEN 'improving' WHEN recent - before < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM m""")
def entity_sentiment(spark, d):
    v = F.when(F.col("label") == "positive", 1.0).when(F.col("label") == "negative", -1.0).otherwise(0.0)
    new = F.col("ts") >= F.lit("2024-01-23 00:00:00").cast("timestamp_ntz")
    m = signals(spark, d).groupBy("entity").agg(F.avg(v).alias("overall"), F.avg(F.when(new, v)).alias("recent"), F.avg(F.when(~new, v)).alias("before"), F.count(F.when(v > 0, 1)).alias("positive"))
    diff = F.col("recent") - F.col("before")
    return m.select("entity", *[F.round(c, 5).alias(c) for c in ("overall", "recent", "before")], "positive", F.when(diff > 0.05, "improving").when(diff < -0.05, "declining").otherwise("stable").alias("trend"))


@query("SELECT toxic, count(*) AS n, round(avg(quality), 3) AS average, count(*) FILTER (quality >= 1) AS positive, count(*) FILTER (quality < 1) AS negative FROM labels GROUP BY 1")
def feedback_stats(spark, d):
    return D.rating_stats(table(spark, d, "labels"), "toxic", "quality")


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, 'new ' || c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal + 1 END AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS value FROM o FULL JOIN n ON o.id = n.id""")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("value"))
    return D.upserted(old, new, ["id"], ["value"])


@query("""WITH t AS (SELECT s_suppkey, s_name, lower('  ' || s_name || ' ') AS p, lower('  supplier#000000001 ') AS q FROM supplier), g AS (SELECT s_suppkey, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS a, list_distinct(list_transform(range(1, length(q) - 1), lambda i: substr(q, i, 3))) AS b FROM t)
SELECT s_suppkey, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g WHERE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.3""")
def trigram_search(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", X.trigram_similarity(F.col("s_name"), F.lit("supplier#000000001")).alias("similarity"))
    return s.filter("similarity >= 0.3").select("s_suppkey", F.round("similarity", 6).alias("similarity"))


@query("""SELECT conv_id, turn, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER) AS mentions, round(CASE WHEN len(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) > 0 THEN 1000.0 * CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER) / len(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) END, 4) AS density FROM conversations""".replace("\\\\", "\\"))
def term_density(spark, d):
    t = table(spark, d, "conversations")
    n = F.size(X.words(F.col("text")))
    m = X.mentions(F.col("text"), "the")
    return t.select("conv_id", "turn", m.alias("mentions"), F.round(F.when(n > 0, 1000.0 * m / n), 4).alias("density"))


@query("SELECT p_partkey, 'clk_' || substr(sha256(lower(trim(p_brand)) || chr(0) || lower(trim(p_type)) || chr(0) || lower(trim(p_name))), 1, 16) AS claim_key FROM part")
def claim_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", X.keyed_id("clk", F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("claim_key"))
