"""The columns of the numbered queries that SQL can express, as queries of their own, and their SQL.

Where a query's verdict (a model's score, a flow, a divergence) is beyond SQL, what it
rests on isn't: lengths, sizes, counts and the unigram base are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lm_scoring import op9_lattice_lm
from .packing import op6_bucket_packing
from .quality import op8_divergence_quality
from .resharding import op7_flow_resharding


def packing_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of op6."""
    return op6_bucket_packing(spark, sf_dir).select("doc_id", "n_tokens")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32 of op7."""
    return op7_flow_resharding(spark, sf_dir).select("doc_id", "size", "text_crc32")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8."""
    return op8_divergence_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return op9_lattice_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def _crc32(text: str) -> str:
    """CRC-32 of a string expression's UTF-8 bytes; the polynomial's table is the column t of the relation crc."""
    h = f"hex(encode({text}))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "packing_lengths": rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS n_tokens FROM documents",
    "shard_sizes": f"WITH {_TABLE} SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {_crc32("coalesce(text, '')")}::BIGINT AS text_crc32 FROM documents, crc",
    "quality_counts": rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT u, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT u, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY u),
s AS (SELECT u, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT u, count(DISTINCT p) AS n_repeat FROM (SELECT u, unnest([i, i + 1, i + 2]) AS p FROM (SELECT u, i, count(*) OVER (PARTITION BY u, s) AS n FROM s) WHERE n > 1) GROUP BY u),
c AS (SELECT u, doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (u) LEFT JOIN r USING (u))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
""",
    "unigram_scores": rf"""
WITH {_TABLE},
d AS (SELECT row_number() OVER () AS u, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out, list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), lambda x: 'w' || x), 'end') AS w FROM documents, crc),
k AS (SELECT u, doc_id, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM k WHERE NOT held_out GROUP BY token),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)))::DOUBLE AS base_score FROM k LEFT JOIN c USING (token), n GROUP BY u, doc_id, held_out
""",
}
QUERIES = {"packing_lengths": packing_lengths, "shard_sizes": shard_sizes, "quality_counts": quality_counts, "unigram_scores": unigram_scores}
