"""Queries on keywords of documents and the index of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords as K, text_index as I
from .bind import table
from .registry import ORACLE_SQL, query

_STOP = ", ".join(f"'{w}'" for w in sorted(K.STOP))
_TEXTRANK = (
    rf"""WITH t AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]+') AS ts FROM documents),
k AS (SELECT u, doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM t), m AS (SELECT *, regexp_matches(w, '^[\p{{L}}\p{{N}}]') AS is_word FROM k),
p AS (SELECT *, sum(is_word::INTEGER) OVER (PARTITION BY u ORDER BY i) AS place, is_word AND length(w) >= {K.SHORTEST} AND w NOT IN ({_STOP}) AS able FROM m),
c AS MATERIALIZED (SELECT u, doc_id, w, i, place FROM p WHERE able), g AS (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS g),
e AS (SELECT a.u, a.w AS x, b.w AS y, count(*) AS n FROM (SELECT u, w, place + g AS near FROM c, g) a JOIN c b ON a.u = b.u AND a.near = b.place AND a.w <> b.w GROUP BY ALL),
f AS MATERIALIZED (SELECT u, x, y, n / sum(n) OVER (PARTITION BY u, x) AS share FROM e),
v AS MATERIALIZED (SELECT u, w, count(*) OVER (PARTITION BY u) AS size FROM (SELECT DISTINCT u, w FROM c)), r0 AS (SELECT u, w, 1.0::DOUBLE / size AS r FROM v), """
    + ", ".join(
        f"r{k} AS MATERIALIZED (SELECT v.u, v.w, {1 - K.DAMPING:.2f}::DOUBLE / size + {K.DAMPING}::DOUBLE * coalesce(s, 0) AS r FROM v LEFT JOIN (SELECT f.u, y, sum(share * r) AS s FROM f JOIN r{k - 1} q ON f.u = q.u AND f.x = q.w GROUP BY 1, 2) n ON v.u = n.u AND v.w = n.y)"
        for k in range(1, K.ROUNDS + 1)
    )
    + f""", h AS (SELECT *, i - row_number() OVER (PARTITION BY u ORDER BY i) AS run FROM c), o AS (SELECT *, (row_number() OVER (PARTITION BY u, run ORDER BY i) - 1) // {K.LONGEST} AS piece FROM h),
z AS (SELECT o.u, doc_id, string_agg(o.w, ' ' ORDER BY i) AS keyword, sum(r ORDER BY i) AS score FROM o JOIN r{K.ROUNDS} q ON o.u = q.u AND o.w = q.w GROUP BY o.u, doc_id, run, piece),
y AS (SELECT u, doc_id, keyword, round(min(score), 9) AS score, count(*) AS count FROM z GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, keyword) AS rank FROM y)
SELECT doc_id, rank::INTEGER AS rank, keyword, round(score, 6) AS score, count FROM x WHERE rank <= {K.LIMIT}"""
)


@query(_TEXTRANK)
def textrank_keywords(spark, d):
    return K.textrank(table(spark, d, "documents")).withColumn("score", F.round("score", 6))


#: Searches, each for rows with all of its terms.
_SEARCHES = [["les", "pour"], ["the", "of", "that"], ["and"]]
_LIST = r"list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '')"


def _cover_sql(n: int, terms: list[str]) -> str:
    lasts = ", ".join(f"max(CASE WHEN w = '{t}' THEN k END) OVER (PARTITION BY u ORDER BY k) AS l{i}" for i, t in enumerate(terms))
    every, least = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(terms))), ", ".join(f"l{i}" for i in range(len(terms)))
    return f"""(WITH e{n} AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY p) AS k FROM p WHERE w IN ({", ".join(f"'{t}'" for t in terms)})), f{n} AS (SELECT u, doc_id, p, k, {lasts} FROM e{n}),
c{n} AS (SELECT u, doc_id, least({least}) AS s, min(k) AS e FROM f{n} WHERE {every} GROUP BY ALL), r{n} AS (SELECT c.u, c.doc_id, sum(0.1::DOUBLE / (1 + (b.p - a.p) - (e - s))) AS rank FROM c{n} c JOIN e{n} a ON c.u = a.u AND s = a.k JOIN e{n} b ON c.u = b.u AND e = b.k GROUP BY ALL)
SELECT {n} AS search, doc_id, round(rank, 6) AS rank FROM r{n} ORDER BY round(r{n}.rank, 9) DESC, doc_id LIMIT 25)"""


@query(f"WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_LIST} AS ws FROM documents), p AS (SELECT u, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d) " + " UNION ALL ".join(_cover_sql(n, t) for n, t in enumerate(_SEARCHES)))
def cover_search(spark, d):
    index = I.build(table(spark, d, "documents"))
    parts = [I.cover_search(spark, index, t, 25).select(F.lit(n).alias("search"), "doc_id", F.round("rank", 6).alias("rank")) for n, t in enumerate(_SEARCHES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(ORACLE_SQL["bm25_search"])
def bm25_indexed(spark, d):
    return I.bm25(spark, I.build(table(spark, d, "documents")), ["les", "pour"]).select("doc_id", F.round("score", 5).alias("score"))
