"""Substring de-duplication by recompression.

Every document is a string of words.  Rounds rename it: the first names runs
of one token with their length, the others replace pairs (x, y) with x on the left side and y on
the right side of an alphabet split by a new name.  A name is a function
of what it replaces, so the names are the same in every task: each round names the
whole corpus alike, and only what the rounds reveal has to be exchanged.  Which pairs are
replaced depends on the two symbols alone, so equal substrings get equal symbols except
near their ends.  For each window of ``window`` words ``certain`` follows which symbols are
certain whatever stands around it.  A symbol at an end that isn't is popped, with its round;
what is popped at both ends and the symbols left at the top spell the window: two windows
have equal spellings if, and but for 96 bits of them that collide (a chance of 1 in 1000 for 10^13 windows), only if their
words are equal.  The leftmost certain symbol of the highest round that still has one is the
window's anchor, a function of the window's content.

1. Anchors (a few per window length) meet by name; names that occur twice are kept.
2. The windows with such an anchor meet by their spelling, which verifies the repeat.
3. Words covered by a repeated window are removed.

Nothing is sampled or capped.  A bucket of the exchange holds names only;
a task first merges what it has itself, so a passage shared by a third of all
rows reaches its bucket once for each flush of a task, and what documents have to
be told is spread by document.

Null or empty text: no words, nothing removed, the hash of the empty string.
Rows are identified by their place in the input, so repeated rows and repeated
or null ids are separate documents.  A ``text`` that is shorter than the window
is never changed.  Other columns of the input are passed by ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange as X
from .storage import discard, numbered, table
from .textops import _K2, U64, Words, mix, pair, shingles, slices

WINDOW = 35
#: r: collapse runs, p: replace pairs.
ROUNDS = "rpppppp"


def certain(names: np.ndarray, others: np.ndarray | None, row_first: np.ndarray, rounds: str, start: np.ndarray, window: int):
    """For windows that begin at the word indices start: (anchor name, anchor's place) or, with others, their spelling's two halves.

    names, others: both halves of the words' names, rows back to back; row_first: first word of each row and the end.
    A window whose symbols are never certain (it lies in one or two runs) has its first word as anchor.
    """
    spelled, halves = others is not None, (0, 1) if others is not None else (0,)
    sym, pos = [names, others], np.arange(len(names))
    border = np.zeros(len(names) + 1, bool)
    border[row_first] = True
    at, lo, hi = np.arange(len(start)), start, start + window
    anchor, place, level = names[start].copy(), start.copy(), np.zeros(len(start), np.int64)
    left, mid, back = ([np.zeros(len(start) if spelled else 0, U64) for _ in range(2)] for _ in range(3))

    def spell(told, some, i, extra):
        for half in (0, 1):
            told[half][some] = pair(told[half][some], sym[half][i] + extra, half + 1)

    for r, kind in enumerate(rounds, 1):
        m = len(sym[0])
        if not len(at):
            break
        new, merged, step = np.ones(m, bool), np.zeros(m, bool), U64(r * int(_K2) % (1 << 64))
        if kind == "r":
            new[1:] = (sym[0][1:] != sym[0][:-1]) | border[1:m]
            merged[:-1] = ~new[1:]
        else:
            right = (mix(sym[0] + U64(r)) & U64(1)).astype(bool)
            new[1:] = right[:-1] | ~right[1:] | border[1:m]
            merged[:-1] = ~new[1:]
        rank = np.concatenate((np.cumsum(new) - 1, [int(new.sum())]))
        begin = np.append(np.flatnonzero(new), m)
        if kind == "r":  # the runs at both ends may go on outside: what of them lies in the window is popped
            if spelled:
                end_of_first = np.minimum(begin[rank[lo] + 1], hi)
                spell(left, at, lo, step + (end_of_first - lo).astype(U64))
                more = np.flatnonzero(end_of_first < hi)
                spell(back, at[more], hi[more] - 1, step + (hi[more] - np.maximum(begin[rank[hi[more] - 1]], lo[more])).astype(U64))
            lo, hi = rank[lo] + 1, rank[hi - 1]
        else:  # a right symbol may be taken by what stands before the window, a left one by what stands behind it
            if spelled:
                first, last = np.flatnonzero(right[lo]), np.flatnonzero(~right[hi - 1])
                spell(left, at[first], lo[first], step)
                spell(back, at[last], hi[last] - 1, step)
            lo, hi = rank[lo + right[lo]], rank[hi - ~right[hi - 1]]
        for half in halves:
            x = sym[half]
            named = pair(x[new], np.diff(begin).astype(U64), r + 32 * half) if kind == "r" else pair(x, np.concatenate((x[1:], x[:1])), r + 32 * half)[new]
            sym[half] = np.where(merged[new], named, x[new])
        pos, border = pos[new], np.append(border[:m][new], True)
        ok = lo < hi
        at, lo, hi = at[ok], lo[ok], hi[ok]
        if not spelled:
            anchor[at], place[at], level[at] = sym[0][lo], pos[lo], r
    if not spelled:
        return mix(anchor + level.astype(U64)), place * (len(rounds) + 1) + level
    for j in range(int((hi - lo).max()) if len(at) else 0):
        some = np.flatnonzero(lo + j < hi)
        spell(mid, at[some], lo[some] + j, U64(0))
    return tuple(pair(pair(left[h], mid[h], h + 3), back[h], h + 5) for h in (0, 1))


def _windows(data, offsets, window: int, rounds: str):
    """Words of a slice, starts of its windows, names and places of their anchors."""
    w = Words(data, offsets)
    ahead = w.first[w.row + 1] - np.arange(len(w)) if len(w) else np.zeros(0, np.int64)
    start = np.flatnonzero(ahead >= window)
    return w, start, *certain(w.hash, None, w.first, rounds, start, window)


def anchors(batches, n_buckets: int, window: int, rounds: str):
    """Packed (anchor name, document), and whether the document has the anchor at two places."""
    pack = X.Repeats(n_buckets)
    for rows, data, off in slices(batches):
        w, start, name, place = _windows(data, off, window, rounds)
        if not len(start):
            continue
        uid = rows.column("uid").to_numpy()
        _, one = np.unique(place, return_index=True)
        name, row = name[one], w.row[start[one]]
        order = np.lexsort((name, row))
        name, row = name[order], row[order]
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        twice = np.append(same[1:], False)  # its own repeat makes it known here
        pack.add(name[~same], uid[row[~same]], None, twice[~same].astype(np.int64))
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def repeat_candidates(batches, n_buckets: int, window: int, rounds: str):
    """Packed (spelling, document, word) of the windows whose anchor is among the document's repeated names."""
    pack = X.Repeats(n_buckets, "place")
    for rows, data, off in slices(batches):
        w, start, name, _ = _windows(data, off, window, rounds)
        if not len(start):
            continue
        uid = rows.column("uid").to_numpy()
        known, of = X.lists(rows.column("hits"))
        row = w.row[start]
        ok = np.isin(X.row_key(row, name), X.row_key(of, known))
        start, row = start[ok], row[ok]
        if len(start):
            one, two = certain(w.hash, w.second(), w.first, rounds, start, window)
            at = np.empty(len(start), X.NAMED)
            at["second"], at["place"] = two >> U64(32), start - w.first[row]
            pack.add(one, uid[row], at)
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def _strip(batches, window: int):
    for rows, data, off in slices(batches):
        w = Words(data, off, hashed=False)
        place, of = X.lists(rows.column("hits"), np.int32)
        cover = np.zeros(len(w) + 1, np.int64)
        begin = w.first[of] + place
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.counts > 0) if len(w.counts) else w.counts
        raw, kept = data.tobytes(), []
        for r in range(rows.num_rows):
            i, j = w.first[r], w.first[r + 1]
            if not n_removed[r]:
                kept.append(b" ".join(raw[off[r] : off[r + 1]].split()))
            else:
                kept.append(b" ".join([raw[a:b] for a, b in zip(w.starts[i:j][~gone[i:j]].tolist(), w.ends[i:j][~gone[i:j]].tolist(), strict=True)]))
        yield rows, w.counts, n_removed, kept


def remove_repeats(spark: SparkSession, docs: DataFrame, keep: list[str], window: int = WINDOW, rounds: str = ROUNDS, digest: bool = False) -> DataFrame:
    """The columns ``keep`` of docs (but for clashing names) with n_words, n_removed and kept_text (digest: kept_sha256 in its place).

    docs needs ``text``; a word goes if a window of ``window`` words that covers it also starts elsewhere.
    """
    n = X.buckets(spark, docs)
    keep = [c for c in keep if c not in ("n_words", "n_removed", "kept_text", "kept_sha256")]
    base = numbered(docs, [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text"])
    named = X.meet(base.mapInArrow(lambda it: anchors(it, n, window, rounds), X.PACKED), n)
    hits = table(X.told(named.mapInArrow(lambda it: X.Repeats.answer(it, n), X.PACKED), n))
    some = table(base.select("uid", "text").join(hits, "uid"))
    discard(hits)
    cand = X.meet(some.mapInArrow(lambda it: repeat_candidates(it, n, window, rounds), X.PACKED), n)
    places = table(X.told(cand.mapInArrow(lambda it: X.Repeats.answer(it, n, "place"), X.PACKED), n, np.int32))
    discard(some)
    last = "kept_sha256 string" if digest else "kept_text string"
    columns = base.schema["kept_columns"].dataType

    def strip(batches):
        for rows, n_words, n_removed, kept in _strip(batches, window):
            out = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), out], names=["kept_columns", "n_words", "n_removed", last.split()[0]])

    found = base.join(places, "uid", "left").select("kept_columns", "text", "hits").mapInArrow(strip, f"kept_columns {columns.simpleString()}, n_words long, n_removed long, {last}")
    return found.select(*[F.col(f"kept_columns.`{c}`") for c in keep], "n_words", "n_removed", last.split()[0])


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], digest=True)


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT u, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT u, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT u, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)),
x AS (SELECT u, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.u, count(cov.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (cov.p IS NULL) AS kept FROM x LEFT JOIN cov ON x.u = cov.u AND x.p = cov.p GROUP BY x.u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (u)
"""
