"""Queries on density clusters, changes of themes, near duplicates across batches, and the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import density as D, signature_store as S, theme_updates as U, vector_index as I, vectors as V
from ..operators.keywords import STOP
from ..sources.scratch import shared_dir, table as table_of
from .bind import table
from .registry import query

_SIMILAR = 0.35


@query()
def density_themes(spark, d):
    return D.density_clusters(table(spark, d, "embeddings"), least=5)


@query(f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s WHERE s >= {_SIMILAR})
SELECT query, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 20""")
def indexed_search(spark, d):
    e = table(spark, d, "embeddings")
    found = I.search(spark, I.build(e), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), 20, _SIMILAR)
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_MERGE = 0.02


@query()
def theme_merges(spark, d):
    """Themes are labels by remainder of the id, so that there are several to merge."""
    e = table(spark, d, "embeddings").withColumn("theme", F.col("label") * 4 + F.col("vec_id") % 4)
    themes = table_of(V.centroids(e, "theme").withColumnRenamed("members", "n"))
    pairs = V.merge_candidates(themes, "theme", _MERGE).withColumn("similarity", F.round("similarity", 9))
    merges = table_of(U.greedy_merges(pairs, themes.select("theme", "n")))
    words = themes.select("theme", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w")).select("theme", F.concat(F.lit("w"), (F.col("theme") + F.col("w")).cast("string")).alias("word"), (F.col("theme") % 7 + F.col("w")).cast("double").alias("score"))
    out = U.merged_themes(themes, words, merges)
    return out.select("theme", "n", F.array_join("merged_from", ",").alias("merged_from"), F.to_json("words").alias("words"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_STOP = ", ".join(f"'{w}'" for w in sorted(STOP))


@query(rf"""WITH d AS (SELECT row_number() OVER () AS u, lang, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM documents WHERE lang IS NOT NULL),
t AS (SELECT u, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS word FROM d), f AS (SELECT u, lang, word, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, word) AS k FROM (SELECT lang, word, sum(tf) AS total, count(*) AS df FROM f GROUP BY ALL)), n AS (SELECT lang, count(*) AS n FROM d GROUP BY 1),
i AS (SELECT lang, word, ln((1 + n) / (1 + df)) + 1 AS idf FROM a JOIN n USING (lang) WHERE k <= 1000), w AS (SELECT u, lang, word, tf * idf AS w FROM f JOIN i USING (lang, word)), m AS (SELECT u, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
s AS (SELECT lang, word, round(sum(w / norm), 9) AS score FROM w JOIN m USING (u) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, word) AS rank FROM s)
SELECT lang, word, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def tfidf_keywords(spark, d):
    return U.tfidf_keywords(table(spark, d, "documents"), "lang", "doc_id").withColumn("score", F.round("score", 6))


@query()
def new_themes(spark, d):
    """Vectors of six labels stand for the themes there are; the others are the outliers."""
    e = table(spark, d, "embeddings")
    themes = V.centroids(e.filter("label < 6"), "label").select(F.col("label").cast("string").alias("theme_id"), "centroid")
    outliers = e.filter("label >= 6").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    found, members = U.new_themes(outliers, themes, "vec_id", least=6)
    return found.select("theme_id", "name", "members").join(members.groupBy("theme_id").agg(F.count("*").alias("documents"), F.min("vec_id").alias("least_id")), "theme_id")


@query()
def dedupe_batches(spark, d):
    """The documents, one minute after another, in three batches of a signature store."""
    docs = table(spark, d, "documents").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60))
    store, out = S.SignatureStore(f"{shared_dir(spark)}/signatures-{uuid.uuid4().hex}"), None
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    for k in range(3):
        batch = docs.filter((F.col("doc_id") * 3 >= k * (last + 1)) & (F.col("doc_id") * 3 < (k + 1) * (last + 1)))
        part = S.add_batch(spark, store, batch, k, "at").withColumn("batch", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
