"""Queries that read provider payloads; orders, parts and customers spell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads as P
from ..sources.scratch import parts
from .bind import table
from .registry import query


def _maker():
    return F.concat(F.lit("M"), (F.col("p_size") % 3).cast("string"))


def _box():
    return F.concat(F.lit("C"), (F.col("p_size") % 4).cast("string"))


def _json(*pairs):
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


def _rows(df, key, row):
    """One array of rows for each key."""
    return df.groupBy(key).agg(F.collect_list(row).alias("rows"))


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, CAST(date_trunc('quarter', o_orderdate)::DATE AS VARCHAR) AS observation_date, CASE WHEN o_orderkey % 6 > 0 THEN round(o_totalprice, 2) END AS value, CASE WHEN o_orderkey % 6 = 0 THEN 'missing' END AS missing_reason, 'Level' AS unit FROM orders")
def read_accounts(spark, d):
    o = table(spark, d, "orders")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    value = F.when(F.col("o_orderkey") % 6 == 0, "---").otherwise(F.format_number("o_totalprice", 2))
    row = F.struct(period.alias("TimePeriod"), F.when(value == "---", "--").otherwise(value).alias("DataValue"), F.lit("Level").alias("CL_UNIT"))
    lines = _rows(o, F.col("o_custkey"), row).select(F.to_json(F.struct(F.struct(F.struct(F.col("rows").alias("Data")).alias("Results")).alias("BEAAPI"))).alias("value"))
    return P.quarterly_accounts(lines).select("period", F.col("observation_date").cast("string").alias("observation_date"), F.round("value", 2).alias("value"), "missing_reason", "unit")


@query("SELECT CAST(o_orderdate::DATE AS VARCHAR) AS observation_date, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 2) END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' END AS missing_reason FROM orders")
def read_fiscal(spark, d):
    o = table(spark, d, "orders")
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("record_date"), F.when(F.col("o_orderkey") % 5 == 0, "null").otherwise(F.col("o_totalprice").cast("string")).alias("rate"))
    lines = _rows(o, F.col("o_custkey"), row).select(F.to_json(F.struct(F.col("rows").alias("data"))).alias("value"))
    return P.fiscal_rows(lines, "rate").select(F.col("observation_date").cast("string").alias("observation_date"), F.round("value", 2).alias("value"), "missing_reason")


@query("SELECT CAST(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END::DATE AS VARCHAR) AS observation_date, round(o_totalprice, 2) AS value, 'barrels' AS units, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS revision FROM orders")
def read_energy(spark, d):
    o = table(spark, d, "orders")
    period = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.struct(period.alias("period"), F.col("o_totalprice").cast("string").alias("value"), F.lit("barrels").alias("value-units"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).alias("updated"))
    lines = _rows(o, F.col("o_custkey"), row).select(F.to_json(F.struct(F.struct(F.col("rows").alias("data")).alias("response"))).alias("value"))
    return P.energy_series(lines).select(F.col("observation_date").cast("string").alias("observation_date"), F.round("value", 2).alias("value"), "units", "revision")


@query("""SELECT 'W' || CAST(p_partkey AS VARCHAR) AS record_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'M' || CAST(p_size % 3 AS VARCHAR) || ',' || p_brand ELSE 'M' || CAST(p_size % 3 AS VARCHAR) END AS authors, p_brand || '-lab' AS institutions, p_type || CASE WHEN p_size % 3 = 0 THEN ',' || 'C' || CAST(p_size % 4 AS VARCHAR) ELSE '' END AS topics, CASE WHEN p_size % 4 > 0 THEN '2024-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') END AS published,
 CASE WHEN p_size % 5 > 0 THEN '10.1/' || CAST(p_partkey AS VARCHAR) END AS doi, CASE WHEN p_size % 2 = 0 THEN 'https://x/' || CAST(p_partkey AS VARCHAR) ELSE 'W' || CAST(p_partkey AS VARCHAR) END AS url FROM part""")
def read_works(spark, d):
    p, s = table(spark, d, "part"), F.col("p_size")
    name = lambda c: F.struct(c.alias("display_name"))
    lab = F.struct(F.concat("p_brand", F.lit("-lab")).alias("display_name"), F.lit("i1").alias("id"))
    one = F.struct(name(_maker()).alias("author"), F.array(lab).alias("institutions"))
    two = F.struct(name(F.when(s % 2 == 0, F.col("p_brand")).otherwise(_maker())).alias("author"), F.array(lab).alias("institutions"))
    key = F.col("p_partkey").cast("string")
    work = F.struct(
        F.concat(F.lit("W"), key).alias("id"), F.col("p_name").alias("display_name"), F.when(s % 4 > 0, F.concat(F.lit("2024-01-"), F.lpad((1 + s % 28).cast("string"), 2, "0"))).otherwise("soon").alias("publication_date"), F.when(s % 5 > 0, F.concat(F.lit("https://doi.org/10.1/"), key)).alias("doi"),
        F.array(one, two).alias("authorships"), F.array(name(F.col("p_type"))).alias("topics"), F.array(name(F.when(s % 3 == 0, _box()).otherwise(F.col("p_type")))).alias("concepts"), F.when(s % 2 == 0, F.struct(F.concat(F.lit("https://x/"), key).alias("landing_page_url"))).alias("primary_location"),
    )
    lines = p.groupBy(F.col("p_partkey") % 20).agg(F.to_json(F.struct(F.collect_list(work).alias("results"))).alias("value"))
    joined = lambda c: F.concat_ws(",", c).alias(c)
    return P.works(lines).select("record_id", "title", joined("authors"), joined("institutions"), joined("topics"), F.col("published").cast("string").alias("published"), "doi", "url")


@query("""SELECT CAST(p_partkey AS VARCHAR) || 'v1' AS record_id, p_name AS title, 'M' || CAST(p_size % 3 AS VARCHAR) || ',' || p_brand AS authors, 'cs.' || CAST(p_size % 5 AS VARCHAR) AS categories, '2024-03-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS published, CASE WHEN p_size % 2 = 0 THEN '10.2/' || CAST(p_partkey AS VARCHAR) END AS doi, 'https://y/' || CAST(p_partkey AS VARCHAR) AS url FROM part""")
def read_preprints(spark, d):
    p, key = table(spark, d, "part"), F.col("p_partkey").cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), key, F.lit("v1</id><title>\n "), F.col("p_name"), F.lit(" </title><summary>s</summary><published>2024-03-"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"), F.lit("T10:00:00Z</published><author><name>"), _maker(),
        F.lit("</name></author><author><name> "), F.col("p_brand"), F.lit("</name></author><category term='cs."), (F.col("p_size") % 5).cast("string"), F.lit("'/>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<arxiv:doi>10.2/"), key, F.lit("</arxiv:doi>"))).otherwise(""),
        F.lit("<link rel='self' href='z'/><link rel='alternate' href='https://y/"), key, F.lit("'/></entry>"),
    )
    lines = p.groupBy(F.col("p_partkey") % 20).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    return P.preprints(lines).select("record_id", "title", F.concat_ws(",", "authors").alias("authors"), F.concat_ws(",", "categories").alias("categories"), F.col("published").cast("string").alias("published"), "doi", "url")


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN '' ELSE 'P' || CAST(p_partkey AS VARCHAR) END AS patent_id, 'A' || CAST(p_partkey AS VARCHAR) AS application_id, CASE WHEN p_size % 4 = 0 THEN 'F' || CAST(p_size AS VARCHAR) ELSE 'A' || CAST(p_partkey AS VARCHAR) END AS family_id, p_name AS title, 'M' || CAST(p_size % 3 AS VARCHAR) || ',' || p_brand AS assignees, CASE WHEN p_size % 3 > 0 THEN '2023-05-06' END AS grant_date, 45 AS snapshot_age_days, false AS snapshot_stale FROM part""")
def read_bulk_patents(spark, d):
    p, key, s = table(spark, d, "part"), F.col("p_partkey").cast("string"), F.col("p_size")
    rows = p.select(
        F.when(s % 3 > 0, F.concat(F.lit(" P"), key)).alias("patent_number"), F.concat(F.lit("A"), key).alias("application_id"), F.when(s % 4 == 0, F.concat(F.lit("F"), s.cast("string"))).alias("familyId"), F.lit("").alias("invention_title"), F.col("p_name").alias("title"),
        F.concat(_maker(), F.lit("; "), "p_brand").alias("assignees"), F.lit("G06F").alias("cpc_group_id"), F.when(s % 3 > 0, "2023-05-06").otherwise("n/a").alias("grant_date"),
    )
    out = P.bulk_patents(rows, F.lit("2024-01-01").cast("date"), F.lit("2024-02-15").cast("date"))
    return out.select("patent_id", "application_id", "family_id", "title", F.concat_ws(",", "assignees").alias("assignees"), F.col("grant_date").cast("string").alias("grant_date"), "snapshot_age_days", "snapshot_stale")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, k FROM orders, range(2) r(k) WHERE o_orderkey % 7 > 0 AND (k = 0 OR o_orderkey % 3 = 0))
SELECT 'acc' || CAST(o_orderkey AS VARCHAR) AS accession, CASE k WHEN 0 THEN 'form4_non_derivative_transaction' ELSE 'form4_derivative_transaction' END AS event_type, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS issuer_cik, CASE WHEN o_orderkey % 5 > 0 THEN 'own' END AS filer_cik, CASE k WHEN 0 THEN 'P' ELSE 'S' END AS code, '2024-01-02' AS transaction_date, (1000 + o_orderkey)::DOUBLE AS shares, CASE k WHEN 0 THEN NULL ELSE 10.5 END::DOUBLE AS price, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 THEN 'resolved' ELSE 'unresolved' END AS mapping_status FROM t""")
def read_insider_transactions(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    o = o.repartition(parts(o), "o_orderkey")  # small files give much XML to parse
    deal = lambda code, price: F.concat(F.lit(f"<securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), F.format_number(1000 + k, 0), F.lit(f"</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare></transactionAmounts>"))
    xml = F.concat(
        F.lit("<ownershipDocument><issuer>"), F.when(k % 2 == 0, F.concat(F.lit("<issuerCik>c"), F.col("o_custkey").cast("string"), F.lit("</issuerCik>"))).otherwise("<issuerName>n</issuerName>"), F.lit("</issuer><reportingOwner><reportingOwnerId>"), F.when(k % 5 > 0, "<rptOwnerCik>own</rptOwnerCik>").otherwise("<rptOwnerName>x</rptOwnerName>"), F.lit("</reportingOwnerId></reportingOwner>"),
        F.when(k % 7 > 0, F.concat(F.lit("<nonDerivativeTable><nonDerivativeTransaction>"), deal("P", ""), F.lit("</nonDerivativeTransaction></nonDerivativeTable>"))).otherwise(""),
        F.when((k % 7 > 0) & (k % 3 == 0), F.concat(F.lit("<derivativeTable><derivativeTransaction>"), deal("S", "10.5"), F.lit("</derivativeTransaction></derivativeTable>"))).otherwise(""), F.lit("</ownershipDocument>"),
    )
    good, _ = P.insider_transactions(o.select(F.concat(F.lit("acc"), k.cast("string")).alias("accession"), F.col("o_custkey").alias("cik"), F.lit(None).cast("string").alias("ticker"), xml.alias("content")))
    return good.select("accession", "event_type", "issuer_cik", "filer_cik", "code", F.col("transaction_date").cast("string").alias("transaction_date"), F.col("shares").cast("double").alias("shares"), F.col("price").cast("double").alias("price"), "mapping_status")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS source, CAST(c_custkey AS VARCHAR) AS target, 'supplies_to' AS predicate, n_aliases FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_aliases FROM customer) WHERE c_nationkey IN (SELECT c_custkey FROM customer)""")
def coverage_seed(spark, d):
    c = table(spark, d, "customer")
    concept = F.struct(F.col("c_custkey").cast("string").alias("concept_id"), F.col("c_name").alias("name"), F.lit("company").alias("type"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_mktsegment"))).alias("aliases"))
    relation = F.struct(F.col("c_nationkey").cast("string").alias("source"), F.col("c_custkey").cast("string").alias("target"), F.lit("supplies_to").alias("predicate"))
    packs = c.groupBy(F.col("c_custkey") % 10).agg(F.to_json(F.struct(F.collect_list(concept).alias("concepts"), F.collect_list(relation).alias("relations"))).alias("value"))
    _, aliases, relations = P.seed_objects(packs)
    n = aliases.groupBy(F.col("concept_id").alias("target")).agg(F.count("*").cast("int").alias("n_aliases"))
    return relations.join(n, "target").select("source", "target", "predicate", "n_aliases")


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN n > 0 THEN s END AS subject FROM (SELECT o_custkey, unnest(CASE WHEN o_custkey % 3 = 0 THEN [NULL] ELSE list('s' || CAST(o_orderkey AS VARCHAR)) END) AS s, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS n FROM orders GROUP BY o_custkey)")
def golden_documents(spark, d):
    o = table(spark, d, "orders")
    claim = F.struct(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"))
    docs = o.groupBy("o_custkey").agg(F.collect_list(claim).alias("l"))
    doc = F.struct(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("text").alias("content"), F.when(F.col("o_custkey") % 3 > 0, F.col("l")).alias("expected_claims"))
    packs = docs.groupBy(F.col("o_custkey") % 7).agg(F.to_json(F.struct(F.collect_list(doc).alias("documents"))).alias("value"))
    return P.golden_set(packs).select("doc_id", "subject")


@query("SELECT 'twitter_' || CAST(event_id AS VARCHAR) AS id, 'post ' || event_type AS content, event_type AS author_name, user_id AS author_followers, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS likes, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at FROM events WHERE event_id % 10 > 0")
def read_scraped_posts(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    one = _json(("tweet_id", k.cast("string")), ("full_text", F.concat(F.lit(" post  "), "event_type")), ("date", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("user", F.struct(F.col("event_type").alias("screen_name"), F.col("user_id").alias("followers_count"))), ("metrics", F.struct(F.floor("value").cast("long").alias("likes"))))
    two = _json(("id", k.cast("string")), ("text", F.concat(F.lit("post "), "event_type")), ("created_at", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("author", F.struct(F.col("event_type").alias("username"), F.col("user_id").alias("followers"))))
    none = _json(("id", k.cast("string")), ("text", F.lit("  ")))
    out = P.scraped_posts(e.select(F.when(k % 10 == 0, none).when(k % 2 == 0, one).otherwise(two).alias("value")))
    return out.select("id", "content", "author_name", "author_followers", "likes", F.unix_seconds("timestamp").alias("at"))
