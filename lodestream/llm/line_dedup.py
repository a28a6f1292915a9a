"""Line de-duplication by winnowing over line hashes.

A document is its sequence of lines with a word (separated by \\n).  Of every
``window`` neighbouring grams of ``gram`` lines the one with the least hash is a
fingerprint (the rightmost of equals), so every run of t = window + gram - 1 lines
holds one, and equal runs hold the same.  Fingerprints meet by hash; only those
found twice go on.  Each of the runs of t lines that a repeated fingerprint
stands for (it extends both ways from there) is verified by its own hash, and
all but its first occurrence, in the order of (id, place in the input, line),
are deleted.  Deleted runs that touch or overlap join to longer ones, so a later
repeat of any length from t on goes as a whole.

With ``lone`` words given, a line of that many words or more is a run of its own
(t = 1), under a name that no other run has, and so is the whole of a document of
fewer than t lines: every one is a fingerprint, whatever its neighbours are.

Null or empty text: no lines, unchanged.  Lines without a word are no part of a
run and stay.  A null id comes after all others.  Repeated rows are copies of
each other: the first keeps its lines.  Other columns pass by ``keep``; columns
whose names clash with the result's (n_lines, n_removed, text) are replaced.  Where
ids aren't whole numbers, rows come in the order of the input instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange as X
from .storage import numbered
from .textops import NEWLINE, SPACE, U64, Words, mix, shingles, slices

WINDOW, GRAM = 2, 1
#: In production a line of so many words is a run of its own.
LONE_WORDS = 8
#: Added to the place of a run of a single line; a document has fewer lines.
SINGLE = 1 << 30


def _lines(data, off):
    """Lines with a word: bytes, row, hash; and each row's first line."""
    lines = Words(data, off, NEWLINE)
    filled = np.concatenate(([0], np.cumsum(~SPACE[data])))
    ok = filled[lines.ends] > filled[lines.starts]
    row = lines.row[ok]
    return lines.starts[ok], lines.ends[ok], row, lines.hash[ok], np.searchsorted(row, np.arange(len(off)))


def winnow(row, value, window: int, gram: int):
    """(starts of runs of window + gram - 1 lines, place of each run's fingerprint, the fingerprints by place)."""
    t = window + gram - 1
    n = len(value)
    prints = shingles(value, gram)
    if n < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), prints
    start = np.flatnonzero(row[: n - t + 1] == row[t - 1 :])
    best, place = prints[start].copy(), start.copy()
    for j in range(1, window):
        p = prints[start + j]
        better = p <= best
        best, place = np.where(better, p, best), np.where(better, start + j, place)
    return start, place, prints


def single(data, off, begin, end, row, value, first, t: int, lone: int | None):
    """(lines that are runs of their own, their names)."""
    if lone is None:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    filled, border = ~SPACE[data], np.zeros(len(data) + 1, bool)
    border[off] = True  # a word doesn't cross rows
    starts = np.concatenate(([0], np.cumsum(filled & (border[:-1] | ~np.concatenate(([False], filled[:-1]))))))
    n_words = starts[end] - starts[begin]
    at = np.flatnonzero((n_words >= lone) | (np.diff(first)[row] < t))
    return at, mix(value[at] + U64(11))


def fingerprints(batches, n_buckets: int, window: int, gram: int, lone: int | None):
    pack = X.Repeats(n_buckets)
    for rows, data, off in slices(batches):
        begin, end, row, value, first = _lines(data, off)
        _, place, prints = winnow(row, value, window, gram)
        one = np.unique(place)
        alone, alone_name = single(data, off, begin, end, row, value, first, window + gram - 1, lone)
        name, of = np.concatenate((prints[one], alone_name)), np.concatenate((row[one], row[alone]))
        order = np.lexsort((name, of))
        name, of = name[order], of[order]
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
        twice = np.append(same[1:], False)[: len(name)]
        pack.add(name[~same], rows.column("uid").to_numpy()[of[~same]], None, twice[~same].astype(np.int64))
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def runs(batches, n_buckets: int, window: int, gram: int, lone: int | None):
    """Packed runs of t lines around repeated fingerprints, and repeated single lines."""
    pack = X.Laters(n_buckets)
    for rows, data, off in slices(batches):
        begin, end, row, value, first = _lines(data, off)
        start, place, prints = winnow(row, value, window, gram)
        known, of = X.lists(rows.column("hits"))
        told = X.row_key(of, known)
        ok = np.isin(X.row_key(row[place], prints[place]), told)
        start = start[ok]
        r = row[start]
        name, at = shingles(value, window + gram - 1)[start], start - first[r]
        alone, alone_name = single(data, off, begin, end, row, value, first, window + gram - 1, lone)
        ok = np.isin(X.row_key(row[alone], alone_name), told)
        alone = alone[ok]
        name, at, r = np.concatenate((name, alone_name[ok])), np.concatenate((at, alone - first[row[alone]] + SINGLE)), np.concatenate((r, row[alone]))
        pack.add(name, rows.column("uid").to_numpy()[r], rows.column("rank").to_numpy()[r], at.astype(np.int32))
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, keep: list[str], id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, lone: int | None = None) -> DataFrame:
    """The columns keep of docs (id_col and text among its own), the remaining text, n_lines and n_removed (lines with a word)."""
    n, t = X.buckets(spark, docs), window + gram - 1
    keep = [c for c in keep if c not in ("text", "n_lines", "n_removed")]
    whole_number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)) if whole_number else F.lit(0).cast("long")
    base = numbered(docs, [rank.alias("rank"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text"])
    hits = X.told(X.meet(base.mapInArrow(lambda it: fingerprints(it, n, window, gram, lone), X.PACKED), n).mapInArrow(lambda it: X.Repeats.answer(it, n), X.PACKED), n)
    found = X.meet(base.join(hits, "uid").mapInArrow(lambda it: runs(it, n, window, gram, lone), X.PACKED), n)
    places = X.told(found.mapInArrow(lambda it: X.Laters.answer(it, n), X.PACKED), n, np.int32)

    def strip(batches):
        for rows, data, off in slices(batches):
            begin, end, row, _, first = _lines(data, off)
            place, of = X.lists(rows.column("hits"), np.int32)
            gone = np.zeros(len(row), bool)
            alone = place >= SINGLE
            gone[first[of[alone]] + place[alone] - SINGLE] = True
            for j in range(t):
                gone[first[of[~alone]] + place[~alone] + j] = True
            n_removed = np.bincount(row[gone], minlength=rows.num_rows) if len(row) else np.zeros(rows.num_rows, np.int64)
            texts = rows.column("text").to_pylist()
            raw = data.tobytes()
            for r in np.flatnonzero(n_removed):
                kept, at = [], int(off[r])
                for k in range(first[r], first[r + 1]):  # what stands between deleted lines, with its own line ends
                    if gone[k]:
                        kept.append(raw[at : begin[k]])
                        at = int(end[k]) + 1
                kept.append(raw[at : off[r + 1]])
                whole = b"".join(kept)
                texts[r] = (whole[:-1] if at > off[r + 1] and whole.endswith(b"\n") else whole).decode()
            yield pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(texts, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64())], names=["kept_columns", "text", "n_lines", "n_removed"])

    out = base.join(places, "uid", "left").mapInArrow(strip, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, text string, n_lines long, n_removed long")
    return out.select(*[F.col(f"kept_columns.`{c}`") for c in keep], "text", "n_lines", "n_removed")


def op5_winnowing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text) of every document."""
    out = remove_repeated_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], lone=LONE_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
f AS (SELECT doc_id, p, line, n_words, lead(line) OVER w AS next_line, lead(p) OVER w AS next_p, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE n_words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, next_p, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, p) AS k FROM f WHERE next_p IS NOT NULL),
s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k FROM f WHERE n_words >= 8 OR n = 1),
x AS (SELECT doc_id, p FROM g WHERE k > 1 UNION SELECT doc_id, next_p FROM g WHERE k > 1 UNION SELECT doc_id, p FROM s WHERE k > 1),
k AS (SELECT l.doc_id, count(*) FILTER (n_words > 0) AS n_lines, count(x.p) AS n_removed, string_agg(line, chr(10) ORDER BY l.p) FILTER (x.p IS NULL) AS kept FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.p = x.p GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
