"""Queries on embeddings and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from .bind import table
from .registry import query

_CENTROIDS = "x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centroid, max(n) AS members FROM m GROUP BY 1)"


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s WHERE s >= 0.05)
SELECT query, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 20""")
def similarity_topk(spark, d):
    e = table(spark, d, "embeddings")
    return V.search(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), 20, 0.05).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_CENTROIDS} SELECT label, members, round(list_sum(centroid), 5) AS total FROM c")
def theme_centroids(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label").select("label", "members", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS n FROM s) SELECT vec_id, label, round(s, 5) AS similarity, CASE WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.3 THEN 'weak' ELSE 'unassigned' END AS strength FROM b WHERE n = 1")
def theme_assign(spark, d):
    e = table(spark, d, "embeddings")
    return V.assigned(e, V.centroids(e, "label"), "label").select("vec_id", "label", F.round("similarity", 5).alias("similarity"), "strength")


@query(f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.centroid, b.centroid), 5) AS similarity FROM c a JOIN c b ON a.label < b.label WHERE list_cosine_similarity(a.centroid, b.centroid) >= 0.05")
def theme_merge_pairs(spark, d):
    return V.merge_candidates(V.centroids(table(spark, d, "embeddings"), "label"), "label", 0.05).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {_CENTROIDS}, r AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1, 2), rc AS (SELECT label, list(m ORDER BY i) AS now FROM r GROUP BY 1) SELECT label, round(1 - list_cosine_similarity(centroid, now), 5) AS distance FROM c JOIN rc USING (label)")
def centroid_stability(spark, d):
    e = table(spark, d, "embeddings")
    return V.stability(e.filter("vec_id % 2 = 0"), V.centroids(e, "label"), "label").select("label", F.round("distance", 5).alias("distance"))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, vec_id % 3 = 0 AS r FROM embeddings), b AS (SELECT r, CASE WHEN (SELECT max(n) > min(n) FROM n) THEN least(49, floor((n - (SELECT min(n) FROM n)) / ((SELECT max(n) FROM n) - (SELECT min(n) FROM n)) * 50)) ELSE 0 END AS bin FROM n),
h AS (SELECT i AS bin, count(*) FILTER (r) AS p, count(*) FILTER (NOT r) AS q FROM range(50) t(i) LEFT JOIN b ON b.bin = t.i GROUP BY 1), s AS (SELECT (p::DOUBLE / sum(p) OVER () + 1e-10) / (1 + 50e-10) AS p, (q::DOUBLE / sum(q) OVER () + 1e-10) / (1 + 50e-10) AS q FROM h)
SELECT round(sum(p * ln(p / q)), 4) AS kl FROM s""")
def embedding_drift_kl(spark, d):
    return V.norm_drift(table(spark, d, "embeddings"), F.col("vec_id") % 3 == 0).select(F.round("kl", 4).alias("kl"))


@query(f"WITH {_CENTROIDS}, w AS (SELECT label, embedding, 0.01 * power(0.99, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1) AS w FROM embeddings), e AS (SELECT label, i, sum(x * w) AS s, count(*) AS n FROM (SELECT label, w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM w) GROUP BY 1, 2) SELECT m.label, m.i - 1 AS i, round(m.m * power(0.99, e.n) + s, 6) AS value FROM m JOIN e ON m.label = e.label AND m.i = e.i")
def centroid_ema(spark, d):
    e = table(spark, d, "embeddings")
    return V.ema_centroids(e, V.centroids(e, "label"), "label", "vec_id").select("label", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


_WORDS = r"list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT lang, word, count(*) AS tf FROM (SELECT lang, unnest({_WORDS}) AS word FROM documents) GROUP BY 1, 2), a AS (SELECT word, sum(tf) AS f FROM w GROUP BY 1), s AS (SELECT lang, sum(tf) AS n FROM w GROUP BY 1),
r AS (SELECT w.lang, w.word, tf / n * ln(1 + (SELECT avg(n) FROM s) / f) AS score FROM w JOIN a USING (word) JOIN s USING (lang)), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, word) AS rank FROM r)
SELECT lang, word, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def class_keywords(spark, d):
    return V.keywords(table(spark, d, "documents"), "lang", 10).select("lang", "word", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 1 - 20) + 1, 80)) AS i FROM w) SELECT doc_id, (i // 80)::INTEGER AS chunk, len(w[i + 1 : i + 100])::INTEGER AS words FROM s""")
def text_chunks(spark, d):
    return V.chunks(table(spark, d, "documents"), 100, 20).select("doc_id", "chunk", F.size("words").alias("words"))


@query()
def dedupe_minhash_lsh(spark, d):
    return V.minhash_classes(table(spark, d, "documents"))
