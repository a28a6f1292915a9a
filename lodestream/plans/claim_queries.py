"""Queries on claims, assertions and publication; lineitem, orders and parts stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S, text as T
from ..operators import claims as C, filings as L, publish as P
from .bind import table
from .registry import query

AT = "2002-01-01 00:00:00"
CLAIMS = """claims AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_partkey % 200 AS subject, ['supplies','drives','blocks'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS predicate, l_suppkey % 50 AS object, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS link, 1 - l_discount AS confidence, 0.5 + l_tax AS weight, 't' || CAST(l_linenumber % 4 AS VARCHAR) AS source_type, l_shipdate AS published_at, CASE WHEN l_quantity < 3 THEN 'retracted' ELSE 'active' END AS status, l_quantity > 48 AS approved, l_extendedprice AS value, l_quantity AS quantity, l_linestatus AS ls FROM lineitem)"""


def claims(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_partkey") % 200).alias("subject"),
        F.get(F.array(*[F.lit(x) for x in ("supplies", "drives", "blocks")]), (F.col("l_suppkey") % 3).cast("int")).alias("predicate"), (F.col("l_suppkey") % 50).alias("object"),
        F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("link"), (1 - F.col("l_discount")).alias("confidence"), (0.5 + F.col("l_tax")).alias("weight"),
        F.concat(F.lit("t"), (F.col("l_linenumber") % 4).cast("string")).alias("source_type"), F.col("l_shipdate").alias("published_at"),
        F.when(F.col("l_quantity") < 3, "retracted").otherwise("active").alias("status"), (F.col("l_quantity") > 48).alias("approved"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("ls"),
    )


KEY = ["subject", "predicate", "object"]
ASSERTIONS = f"""{CLAIMS}, m AS (SELECT subject, predicate, object, sum(confidence * weight) FILTER (link = 'supports') / sum(weight) FILTER (link = 'supports') AS base, count(*) FILTER (link = 'supports') AS supports, count(*) FILTER (link = 'contradicts') AS contradictions, count(DISTINCT source_type) FILTER (link = 'supports') AS source_types, max(published_at) FILTER (link = 'supports') AS last_seen, bool_or(approved) AS ok FROM claims WHERE status <> 'retracted' GROUP BY 1, 2, 3),
assertions AS (SELECT subject, predicate, object, supports, contradictions, source_types, least(1.0, greatest(0.0, coalesce(base, 0) * CASE WHEN last_seen IS NULL THEN 0.5 ELSE exp(-0.01 * greatest(0.0, floor((epoch_us(TIMESTAMP '{AT}') - epoch_us(last_seen)) / 86400000000.0))) END * least(1.0, source_types / 3.0) * (supports::DOUBLE / (supports + contradictions)) + CASE WHEN ok THEN 0.1 ELSE 0 END)) AS confidence,
 CASE WHEN supports = 0 THEN 'retracted' WHEN contradictions > 0 AND supports::DOUBLE / (supports + contradictions) < 0.6 THEN 'disputed' ELSE 'active' END AS status FROM m)"""


def assertions(spark, d):
    return C.aggregated(claims(spark, d), F.lit(AT).cast("timestamp_ntz"), KEY)


@query(f"WITH {ASSERTIONS} SELECT subject, predicate, object, supports, contradictions, source_types, round(confidence, 6) AS confidence, status FROM assertions")
def assertion_aggregate(spark, d):
    return assertions(spark, d).select(*KEY, "supports", "contradictions", "source_types", F.round("confidence", 6).alias("confidence"), "status")


@query(f"""WITH {ASSERTIONS}, b AS (SELECT subject AS concept, 's' AS role, * EXCLUDE (subject, object) FROM assertions WHERE confidence >= 0.1 UNION ALL SELECT object, 'o', * EXCLUDE (subject, object) FROM assertions WHERE confidence >= 0.1)
SELECT concept, count(*) FILTER (role = 's') AS as_subject, count(*) FILTER (role = 'o') AS as_object, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'disputed') AS disputed, round(coalesce(sum(confidence) FILTER (status = 'active'), 0), 5) AS active_confidence, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM b GROUP BY 1""")
def assertion_exposures(spark, d):
    out = C.exposures(assertions(spark, d))
    return out.select("concept", "as_subject", "as_object", "active", "disputed", F.round("active_confidence", 5).alias("active_confidence"), F.concat_ws(",", "predicates").alias("predicates"))


@query(f"""WITH {ASSERTIONS} SELECT subject, predicate, object, CASE WHEN status IN ('retracted','superseded') THEN 'history' WHEN confidence >= 0.3 THEN 'current' WHEN status = 'disputed' THEN 'history' END AS edge FROM assertions""")
def assertion_edges(spark, d):
    return C.derived_edges(assertions(spark, d)).select(*KEY, "edge")


@query(f"""WITH {CLAIMS}, c AS (SELECT *, 'price' AS metric, CASE WHEN quantity < 5 THEN NULL ELSE 'USD' END AS unit, CASE WHEN ls = 'O' THEN 'p' END AS period FROM claims),
a AS (SELECT *, first_value(claim_id) OVER g AS anchor_id, first_value(value) OVER g AS av FROM c WINDOW g AS (PARTITION BY subject, predicate, metric, unit, period ORDER BY confidence DESC, published_at DESC, claim_id DESC))
SELECT claim_id, anchor_id, CASE WHEN unit IS NULL THEN 'incomparable' WHEN claim_id = anchor_id THEN 'anchor' WHEN abs(value - av) / greatest(abs(value), abs(av)) <= 0.05 THEN 'agree' ELSE 'contradict' END AS link FROM a""")
def numeric_link_types(spark, d):
    c = claims(spark, d).withColumns({"metric": F.lit("price"), "unit": F.when(F.col("quantity") >= 5, "USD"), "period": F.when(F.col("ls") == "O", "p")})
    return C.numeric_links(c, ["subject", "predicate"]).select("claim_id", "anchor_id", "link")


@query(f"""WITH {CLAIMS}, r AS (SELECT claim_id, confidence FROM claims WHERE claim_id % 3 <> 0), m AS (SELECT claim_id, confidence / 2 AS confidence FROM claims WHERE claim_id % 2 = 0)
SELECT coalesce(r.claim_id, m.claim_id) AS claim_id, round(coalesce(r.confidence, m.confidence), 6) AS confidence, CASE WHEN r.claim_id IS NOT NULL AND m.claim_id IS NOT NULL THEN 'hybrid' WHEN r.claim_id IS NOT NULL THEN 'rule' ELSE 'model' END AS method FROM (SELECT claim_id, max(confidence) AS confidence FROM r GROUP BY 1) r FULL JOIN (SELECT claim_id, max(confidence) AS confidence FROM m GROUP BY 1) m ON r.claim_id = m.claim_id""")
def claims_merge_hybrid(spark, d):
    c = claims(spark, d)
    one = lambda rows, x: rows.groupBy("claim_id").agg(F.max(x).alias("confidence"))
    return C.merged(one(c.filter("claim_id % 3 <> 0"), F.col("confidence")), one(c.filter("claim_id % 2 = 0"), F.col("confidence") / 2), ["claim_id"]).select("claim_id", F.round("confidence", 6).alias("confidence"), "method")


@query(f"WITH {CLAIMS} SELECT subject, object, CASE WHEN bool_or(link = 'contradicts' AND status = 'active') THEN 'contradicts' WHEN bool_or(link = 'supports' AND status = 'active') THEN 'supports' ELSE 'neutral' END AS link FROM claims GROUP BY 1, 2")
def link_type_merge(spark, d):
    c = claims(spark, d).withColumn("link", F.when(F.col("status") == "active", F.col("link")).otherwise("neutral"))
    return C.merged_links(c, ["subject", "object"])


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate::DATE END AS f, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate::DATE + 120 END AS t FROM orders)
SELECT a.k, a.id AS id_a, b.id AS id_b FROM i a JOIN i b ON a.k = b.k AND a.id < b.id AND coalesce(a.f, DATE '0001-01-01') < coalesce(b.t, DATE '9999-12-31') AND coalesce(b.f, DATE '0001-01-01') < coalesce(a.t, DATE '9999-12-31')""")
def validity_overlap_join(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    i = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 17 != 0, day).alias("valid_from"), F.when(F.col("o_orderkey") % 13 != 0, F.date_add(day, 120)).alias("valid_to"))
    return C.overlapping(i, ["k"])


@query(f"WITH {CLAIMS} SELECT subject, object, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates, count(*) AS claims FROM claims GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1")
def competing_predicates(spark, d):
    return C.competing(claims(spark, d), ["subject", "object"]).select("subject", "object", F.concat_ws(",", "predicates").alias("predicates"), "claims")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS subject, CASE WHEN p_partkey % 15 <> 0 THEN p_brand END AS object, (p_size % 10) / 10.0 AS confidence, p_type AS source_text FROM part),
k AS (SELECT p_partkey, list_filter([CASE WHEN coalesce(length(subject), 0) = 0 THEN 'missing_subject' END, CASE WHEN coalesce(length(object), 0) = 0 THEN 'missing_object' END, CASE WHEN confidence < 0.3 THEN 'low_confidence' END, CASE WHEN length(source_text) > 20 THEN 'long_text' END], lambda x: x IS NOT NULL) AS codes FROM c)
SELECT p_partkey, array_to_string(codes, ',') AS codes, CASE WHEN len(list_filter(codes, lambda x: starts_with(x, 'missing_'))) > 0 THEN 'dead_letter' WHEN len(codes) > 0 THEN 'quarantine' ELSE 'accept' END AS outcome FROM k""")
def claim_quality_checks(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name")).alias("subject"), F.when(F.col("p_partkey") % 15 != 0, F.col("p_brand")).alias("object"), ((F.col("p_size") % 10) / 10.0).alias("confidence"), F.col("p_type").alias("source_text"))
    return C.quality_checked(p, 0.3, 20).select("p_partkey", F.concat_ws(",", "codes").alias("codes"), "outcome")


@query("""WITH m AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(n_name) WHEN 1 THEN 'nat' || CAST(c_nationkey AS VARCHAR) ELSE 'zzz' END AS mention FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(n.n_nationkey, a.n_nationkey, -1) AS concept, CASE WHEN n.n_nationkey IS NOT NULL THEN 'exact' WHEN a.n_nationkey IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS tier FROM m LEFT JOIN nation n ON lower(n.n_name) = lower(trim(mention)) LEFT JOIN nation a ON 'nat' || CAST(a.n_nationkey AS VARCHAR) = lower(trim(mention))""")
def entity_resolution(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.upper("n_name"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("nat"), F.col("c_nationkey").cast("string"))).otherwise("zzz").alias("mention"))
    out = C.resolved(m, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("concept")), n.select(F.concat(F.lit("nat"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_nationkey").alias("concept")))
    return out.select("c_custkey", F.coalesce("concept", F.lit(-1)).alias("concept"), "tier")


@query("""WITH t AS (SELECT DISTINCT l_returnflag AS unit, l_partkey % 500 AS k FROM lineitem WHERE l_linenumber % 2 = 0), f AS (SELECT DISTINCT l_returnflag AS unit, l_partkey % 500 AS k FROM lineitem WHERE l_quantity > 40), j AS (SELECT coalesce(t.unit, f.unit) AS unit, t.k AS tk, f.k AS fk FROM t FULL JOIN f ON t.unit = f.unit AND t.k = f.k)
SELECT coalesce(unit, 'all') AS unit, count(*) FILTER (tk IS NOT NULL AND fk IS NOT NULL) AS tp, count(*) FILTER (fk IS NULL) AS fn, count(*) FILTER (tk IS NULL) AS fp FROM j GROUP BY ROLLUP (unit)""")
def extraction_evaluation(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit"), (F.col("l_partkey") % 500).alias("k"), "l_linenumber", "l_quantity")
    return C.extraction_scores(li.filter("l_linenumber % 2 = 0"), li.filter("l_quantity > 40"), ["k"], "unit").fillna({"unit": "all"})


OBJECTS = """objects AS (SELECT o_orderkey AS object_id, 'lane' || CAST(o_custkey % 5 AS VARCHAR) AS lane, 'm' || CAST(extract(year FROM o_orderdate) AS VARCHAR) AS manifest_id, CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE 'l' || CAST(o_custkey AS VARCHAR) END AS logical_id, o_orderdate AS created_at, o_orderstatus AS state FROM orders),
pointers AS (SELECT lane, arg_max(manifest_id, manifest_id) AS manifest_id FROM objects WHERE created_at <= TIMESTAMP '1999-06-01' GROUP BY 1)"""


def objects(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("object_id"), F.concat(F.lit("lane"), (F.col("o_custkey") % 5).cast("string")).alias("lane"), F.concat(F.lit("m"), F.year("o_orderdate").cast("string")).alias("manifest_id"), F.when(F.col("o_orderkey") % 20 == 0, "").otherwise(F.concat(F.lit("l"), F.col("o_custkey").cast("string"))).alias("logical_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("state"))


def _pointers(o):
    return P.active_pointers(o.select("lane", "manifest_id", F.col("created_at").alias("activated_at")), F.lit("1999-06-01").cast("timestamp_ntz"))


@query(f"""WITH {OBJECTS}, r AS (SELECT o.*, row_number() OVER (PARTITION BY o.lane, coalesce(nullif(logical_id, ''), CAST(object_id AS VARCHAR)) ORDER BY created_at DESC, object_id DESC) AS n FROM objects o JOIN pointers p ON o.lane = p.lane AND o.manifest_id = p.manifest_id)
SELECT lane, object_id, logical_id FROM r WHERE n = 1""")
def read_model_latest(spark, d):
    o = objects(spark, d)
    return P.latest_objects(o, _pointers(o)).select("lane", "object_id", "logical_id")


@query(f"WITH {OBJECTS} SELECT lane, manifest_id FROM pointers")
def manifest_point_in_time(spark, d):
    return _pointers(objects(spark, d))


@query(f"WITH {OBJECTS} SELECT lane, state, count(*) AS objects FROM objects GROUP BY 1, 2")
def read_model_summary(spark, d):
    return P.summary(objects(spark, d), ["lane", "state"])


@query(f"""WITH {OBJECTS}, s AS (SELECT lane, object_id, CASE state WHEN 'O' THEN 'draft' WHEN 'F' THEN 'validated' ELSE 'published' END AS state, CASE object_id % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'published' ELSE 'retracted' END AS t FROM objects)
SELECT object_id, (state, t) IN (('draft','validated'),('validated','published'),('published','retracted')) AS allowed, CASE WHEN (state, t) IN (('draft','validated'),('validated','published'),('published','retracted')) THEN t ELSE state END AS new_state FROM s""")
def object_transitions(spark, d):
    s = objects(spark, d).select("object_id", F.when(F.col("state") == "O", "draft").when(F.col("state") == "F", "validated").otherwise("published").alias("state"), F.when(F.col("object_id") % 3 == 0, "validated").when(F.col("object_id") % 3 == 1, "published").otherwise("retracted").alias("target_state"))
    return P.transitioned(s).select("object_id", "allowed", "new_state")


_LINE = """'{"object_id":' || CAST(object_id AS VARCHAR) || ',"state":"' || state || '"}'"""


@query(f"WITH {OBJECTS} SELECT lane, 'sha256:' || sha256(string_agg({_LINE}, chr(10) ORDER BY object_id)) AS checksum, count(*) AS lines FROM objects GROUP BY 1")
def bundle_checksum(spark, d):
    return P.bundle_checksum(P.bundle_lines(objects(spark, d).select("lane", "object_id", "state"), "object_id"), "object_id")


@query(f"""WITH {OBJECTS}, p AS (SELECT 'objects.jsonl' AS lane, object_id, {_LINE} AS line FROM objects UNION ALL SELECT 'rollups.jsonl', c_custkey, '{{"object_id":' || CAST(c_custkey AS VARCHAR) || '}}' FROM customer),
a AS (SELECT lane, 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY object_id)) AS checksum, count(*) AS lines FROM p GROUP BY 1)
SELECT * FROM a UNION ALL SELECT 'manifest.json', 'sha256:' || sha256('{{' || string_agg('"' || lane || '":"' || checksum || '"', ',' ORDER BY lane) || '}}'), 1 FROM a""")
def composite_bundle(spark, d):
    lines = P.bundle_lines(objects(spark, d).select("lane", "object_id", "state"), "object_id")
    rollups = table(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.to_json(F.struct(F.col("c_custkey").alias("object_id"))).alias("line"))
    return P.composite_bundle(lines, rollups)


@query(f"WITH {OBJECTS} SELECT lane, lane <> 'F' AS intact FROM (SELECT DISTINCT lane FROM objects) UNION ALL SELECT 'none', false")
def bundle_integrity(spark, d):
    lines = P.bundle_lines(objects(spark, d).select("lane", "object_id", "state"), "object_id")
    stored = P.bundle_checksum(lines, "object_id").withColumn("checksum", F.when(F.col("lane") == "F", "sha256:0").otherwise(F.col("checksum"))).select("lane", "checksum")
    extra = spark.createDataFrame([("none", "sha256:1")], "lane string, checksum string")
    return P.bundle_integrity(stored.unionByName(extra), lines, "object_id")


@query("SELECT o_custkey AS bundle, o_orderkey AS object_id, o_orderstatus AS state FROM orders")
def bundle_lines(spark, d):
    o = table(spark, d, "orders")
    head = o.select(F.col("o_custkey").alias("bundle"), F.lit(0).cast("long").alias("pos"), F.lit('{"_type":"manifest_header"}').alias("line")).distinct()
    body = o.select(F.col("o_custkey").alias("bundle"), (F.col("o_orderkey") + 1).alias("pos"), F.to_json(F.struct(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("state"))).alias("line"))
    return P.parsed_bundle(head.unionByName(body), "object_id long, state string").select("bundle", "object_id", "state")


@query(f"WITH {OBJECTS} SELECT 'composite_' || substr(sha256(string_agg(manifest_id, chr(0) ORDER BY manifest_id)), 1, 16) AS composite_id FROM (SELECT DISTINCT manifest_id FROM objects)")
def composite_manifest_id(spark, d):
    return P.composite_id(objects(spark, d))


@query("""WITH r AS (SELECT 'lane' || CAST(o_custkey % 7 AS VARCHAR) AS lane, max(o_orderdate) FILTER (o_custkey % 7 <> 3) AS last, count(*) FILTER (o_orderstatus <> 'P') AS passed, count(*) AS total, max(CASE WHEN o_totalprice > 499990 OR o_custkey % 7 = 5 THEN 2 WHEN o_custkey % 7 = 6 THEN 1 ELSE 0 END) AS q FROM orders GROUP BY 1
 UNION ALL SELECT 'few', TIMESTAMP '2001-08-01', 1, 5, 0),
h AS (SELECT *, CASE WHEN last IS NULL THEN 'unknown' WHEN (epoch_us(TIMESTAMP '2001-08-10') - epoch_us(last)) / 3600000000.0 <= 400 THEN 'fresh' WHEN (epoch_us(TIMESTAMP '2001-08-10') - epoch_us(last)) / 3600000000.0 <= 2000 THEN 'aging' ELSE 'stale' END AS freshness, CASE WHEN total < 10 THEN 'unknown' WHEN passed::DOUBLE / total >= 0.67 THEN 'healthy' WHEN passed::DOUBLE / total >= 0.5 THEN 'degraded' ELSE 'critical' END AS quality, CASE q WHEN 2 THEN 'quarantined' WHEN 1 THEN 'watch' ELSE 'clear' END AS state FROM r)
SELECT lane, freshness, quality, state, CASE WHEN state = 'quarantined' OR freshness = 'stale' OR quality = 'critical' THEN 'blocked' WHEN freshness = 'aging' OR quality = 'degraded' OR state = 'watch' THEN 'warn' ELSE 'ready' END AS readiness FROM h""")
def lane_health(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey") % 7
    state = F.when((F.col("o_totalprice") > 499990) | (k == 5), "quarantined").when(k == 6, "watch").otherwise("clear")
    runs = o.select(F.concat(F.lit("lane"), k.cast("string")).alias("lane"), F.when(k != 3, F.col("o_orderdate")).alias("completed_at"), F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("passed"), F.lit(1).alias("total"), state.alias("state"))
    few = spark.sql("select 'few' as lane, timestamp_ntz'2001-08-01' as completed_at, 1 as passed, 5 as total, 'clear' as state")
    return P.lane_health(runs.unionByName(few), F.lit("2001-08-10").cast("timestamp_ntz"), 400.0, 2000.0, 0.67, 0.5, 10)


@query("SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 2) THEN 'ok' ELSE 'critical' END AS level FROM nation")
def contract_versions(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 0, F.concat(F.lit("v"), F.col("n_regionkey").cast("string"))).alias("version"))
    return P.contract_supported(n, ["v1", "v2"]).select("n_nationkey", "level")


@query("SELECT o_orderpriority AS lane, round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS n, CASE WHEN avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) > 0.5 THEN 'critical' WHEN avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) > 0.33 THEN 'warning' ELSE 'ok' END AS level FROM orders GROUP BY 1")
def lane_failure_rate(spark, d):
    return P.rate_check(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "lane"), "lane", F.col("o_orderstatus") == "P", 0.33, 0.5).select("lane", F.round("rate", 6).alias("rate"), "n", "level")


@query("WITH c AS (SELECT 'lane' || CAST(c_nationkey AS VARCHAR) AS lane, count(*) AS objects FROM customer WHERE c_nationkey < 20 GROUP BY 1) SELECT e.lane, coalesce(objects, 0) AS objects, coalesce(objects, 0) >= 50 AS covered FROM (SELECT 'lane' || CAST(n_nationkey AS VARCHAR) AS lane FROM nation) e LEFT JOIN c USING (lane)")
def coverage_drift(spark, d):
    lane = lambda c: F.concat(F.lit("lane"), F.col(c).cast("string")).alias("lane")
    counts = table(spark, d, "customer").filter("c_nationkey < 20").groupBy(lane("c_nationkey")).agg(F.count("*").alias("objects"))
    return P.coverage_drift(counts, table(spark, d, "nation").select(lane("n_nationkey")), 50)


_SECTION = "CASE role WHEN 'user' THEN 'Risk Factors' WHEN 'assistant' THEN 'Item 7. Management''s Discussion and Analysis of x' ELSE 'Exhibits' END"
_N = r"len(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> ''))"
_M = "CAST((length(lower(text)) - length(replace(lower(text), 'onth', ''))) / 4 AS INTEGER)"
ADOPTION = f"""s AS (SELECT conv_id % 25 AS issuer, conv_id AS period, CASE role WHEN 'user' THEN 0.9 WHEN 'assistant' THEN 1.0 ELSE 0.4 END AS w, {_N} AS n, {_M} AS m FROM conversations),
o AS (SELECT *, n > 0 AND m > 0 AS sig, CASE WHEN n > 0 AND m > 0 THEN least(1.0, m * 1000.0 / n / 20.0) * w END AS depth FROM s),
a AS (SELECT issuer, sum(CASE WHEN sig THEN w ELSE 0 END) / sum(w) AS coverage, coalesce(avg(depth), 0) AS depth, count(DISTINCT CASE WHEN sig THEN period END)::DOUBLE / count(DISTINCT period) AS temporal, count(DISTINCT period) AS periods FROM o GROUP BY 1),
adopted AS (SELECT issuer, coverage, depth, temporal, periods, CASE WHEN issuer % 4 = 0 THEN 0.0 ELSE (issuer % 4) / 4.0 END AS fact_alignment, 0.35 * coverage + 0.25 * depth + 0.2 * CASE WHEN issuer % 4 = 0 THEN 0.0 ELSE (issuer % 4) / 4.0 END + 0.2 * temporal AS adoption FROM a)"""


def _adoption(spark, d):
    t = table(spark, d, "conversations")
    name = F.when(F.col("role") == "user", "Risk Factors").when(F.col("role") == "assistant", "Item 7. Management's Discussion and Analysis of x").otherwise("Exhibits")
    sections = t.select((F.col("conv_id") % 25).alias("issuer"), F.col("conv_id").alias("period"), name.alias("section"), F.size(T.words(F.col("text"))).alias("word_count"), T.mentions(F.col("text"), "onth").alias("mentions"))
    facts = spark.range(25).filter("id % 4 <> 0").select(F.col("id").alias("issuer"), F.lit(4).alias("concepts"), (F.col("id") % 4).alias("matched"))
    return L.adoption(sections, facts, ["issuer"])


@query(f"WITH {ADOPTION} SELECT issuer, round(coverage, 8) AS coverage, round(depth, 6) AS depth, round(temporal, 8) AS temporal, round(adoption, 6) AS adoption FROM adopted")
def filing_adoption(spark, d):
    return _adoption(spark, d).select("issuer", F.round("coverage", 8).alias("coverage"), F.round("depth", 6).alias("depth"), F.round("temporal", 8).alias("temporal"), F.round("adoption", 6).alias("adoption"))


@query(f"""WITH {ADOPTION}, x AS (SELECT *, (issuer * 37) % 100 AS narrative, adoption - 0.45 AS low FROM adopted), y AS (SELECT *, narrative >= 50 AND low < 0.2 AND temporal BETWEEN 0.3 AND 0.7 AND periods >= 2 AS lag FROM x)
SELECT issuer, 'lagging_adoption' AS reason, 'info' AS severity FROM y WHERE lag UNION ALL SELECT issuer, 'narrative_without_filing', CASE WHEN narrative >= 70 AND low < 0.1 THEN 'critical' ELSE 'warning' END FROM y WHERE narrative >= 50 AND low < 0.2 AND NOT lag UNION ALL SELECT issuer, 'filing_without_narrative', 'info' FROM y WHERE narrative < 20 AND low >= 0.6""")
def filing_divergence(spark, d):
    rows = _adoption(spark, d).withColumn("narrative", (F.col("issuer") * 37) % 100).withColumn("adoption", F.col("adoption") - 0.45)
    return L.divergence(rows, ["issuer"])


@query("""SELECT c_custkey, round(least(100.0, least(greatest(c_acctbal / 100, 0) * 0.55, 55.0) + least(greatest((c_custkey % 5) - 2, 0) * 12.0, 18.0) + least(greatest((c_custkey % 7) - 3, 0) * 4.0, 12.0) + least((c_custkey % 6) * 3.0, 9.0) + least(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey % 10) / 10.0 END * 15.0, 12.0) + least((c_custkey % 8) * 2.0, 8.0)), 6) AS impact FROM customer""")
def market_impact(spark, d):
    k = F.col("c_custkey")
    score = S.market_impact(F.col("c_acctbal") / 100, (k % 5 - 2).cast("double"), (k % 7 - 3).cast("double"), k % 6, F.when(k % 3 != 0, (k % 10) / 10.0), k % 8)
    return table(spark, d, "customer").select("c_custkey", F.round(score, 6).alias("impact"))


@query()
def section_alignment(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") % 25).alias("pair"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("name"), F.col("conv_id"))
    return L.aligned(t.filter("conv_id % 2 = 0"), t.filter("conv_id % 2 = 1"), "pair")
