"""Benchmark decontamination with an Aho-Corasick automaton over words.

Texts are normalised (A-Z lower-cased, words of 0-9, a-z and everything beyond
ASCII).  A window is ``window`` consecutive words of a benchmark item; a shorter
item is one window.  The automaton's alphabet is the benchmark's own words, so a
document is scanned once: its words become symbols by one lookup in a sorted
array, stretches of known words that could hold a window run through the
automaton, and hits keep the words' byte offsets in the original text.

The benchmark is counted before anything is broadcast.  Up to ``BLOCK_WORDS`` words
of items are one automaton, and documents are read once.  Of a larger benchmark
only the windows that documents hold can match: a table of ``2 ** BITS`` bits (a
fixed size) marks the benchmark's windows, one pass over the documents writes the
stretches of words that the marks admit, and a second such table, of those stretches'
windows, leaves the benchmark's windows that may occur.  These become automata of
``BLOCK_WORDS`` words at most, one after another, which read the stretches only.
Marks admit more than they must and never less, so the result is the same.

Null text: no words, on either side; items without words match nothing.  An item
with a null id marks words but is not counted.  Repeated items count once,
repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import discard, numbered, table
from .textops import LOWER, NOT_ALNUM, U64, Words, mix, shingles, slices, windows

WINDOW, BLOCK_WORDS = 10, 400_000
BITS, PARTS = 27, 64

_built: dict[str, tuple] = {}


def item_words(batches):
    """(item, words): the item's word hashes."""
    for rows, data, off in slices(batches):
        w = Words(data, off, NOT_ALNUM, LOWER)
        yield pa.RecordBatch.from_arrays([rows.column("item"), pa.array(w.counts, pa.int64()), pa.array([w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())], names=["item", "n", "words"])


def automaton(key: str, found: list, window: int):
    """(sorted words, automaton, least window) of (item or items, word hashes), built once in a Python worker."""
    if key not in _built:
        import ahocorasick

        vocabulary = np.unique(np.concatenate([w for _, w in found]))
        named: dict[tuple, set] = {}
        for items, words in found:
            ids = (np.searchsorted(vocabulary, words) + 1).tolist()
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1):
                named.setdefault(tuple(ids[i : i + k]), set()).update(items)
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, v in named.items():
            machine.add_word(k, (len(k), tuple(x for x in v if x is not None)))
        machine.make_automaton()
        _built.clear()
        _built[key] = vocabulary, machine, min(map(len, named))
    return _built[key]


def matches(w: Words, vocabulary, machine, least: int):
    """(hit words, {row: items})."""
    hit, items = np.zeros(len(w) + 1, np.int64), {}
    if not len(w):
        return hit[:-1] > 0, items
    ids = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    known = vocabulary[ids] == w.hash
    start = known.copy()
    start[1:] &= ~known[:-1] | (w.row[1:] != w.row[:-1])
    begin = np.flatnonzero(start)
    stop = known.copy()
    stop[:-1] &= ~known[1:] | (w.row[1:] != w.row[:-1])
    end = np.flatnonzero(stop) + 1
    long = end - begin >= least
    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        for at, (k, of) in machine.iter(tuple((ids[a:b] + 1).tolist())):
            hit[a + at - k + 1] += 1
            hit[a + at + 1] -= 1
            items.setdefault(int(w.row[a]), set()).update(of)
    return np.cumsum(hit)[:-1] > 0, items


def _spans(w: Words, hit: np.ndarray, off) -> list[list[dict]]:
    """By row: first and last byte of each stretch of hit words."""
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    at = np.flatnonzero(hit)
    if len(at):
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(w.row[at]) > 0)))
        for a, b in zip(at[new].tolist(), at[np.append(new[1:], True)].tolist(), strict=True):
            r = int(w.row[a])
            out[r].append({"begin": int(w.starts[a] - off[r]), "end": int(w.ends[b] - off[r])})
    return out


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def _found(rows, w: Words, off, hit, items: dict):
    """A batch of kept_columns and FOUND."""
    n_hit = np.bincount(w.row[hit], minlength=rows.num_rows) if len(w) else np.zeros(rows.num_rows, np.int64)
    named = pa.array([sorted(items.get(r, ())) for r in range(rows.num_rows)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), named, pa.array(_spans(w, hit, off), _SPAN)], names=["kept_columns", "n_words", "n_hit", "items", "spans"])


def _bits(names: np.ndarray) -> np.ndarray:
    """Two bits of the table for each window name."""
    return np.concatenate([names >> U64(64 - BITS), mix(names + U64(5)) >> U64(64 - BITS)]).astype(np.int64)


def _marked(table_of_bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    one, two = np.split(_bits(names), 2)
    return ((table_of_bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1).astype(bool) & ((table_of_bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def marks(rows: DataFrame, names) -> np.ndarray:
    """The table of bits of the window names that names(batches) yields for rows; 2^BITS bits whatever there are."""
    width = (1 << BITS) // PARTS

    def placed(batches):
        for value in names(batches):
            at = np.unique(_bits(value))
            cut = np.searchsorted(at, np.arange(PARTS + 1) * width)
            some = [p for p in range(PARTS) if cut[p + 1] > cut[p]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(at[cut[p] : cut[p + 1]] - p * width).astype(np.int32).tobytes() for p in some], pa.binary())], names=["part", "at"])

    def added(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("at").to_pylist(), strict=True):
                bits.setdefault(p, np.zeros(width, bool))[np.frombuffer(x, np.int32)] = True
        for p, v in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << BITS) >> 3, np.uint8)
    for r in rows.mapInArrow(placed, "part int, at binary").repartitionById(PARTS, F.col("part")).mapInArrow(added, "part int, bits binary").collect():
        out[r["part"] * width >> 3 : (r["part"] + 1) * width >> 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def _names(words: np.ndarray, k: int) -> np.ndarray:
    return shingles(words, k)


def stretches(batches, sent, lengths: list[int]):
    """(uid, first word, words) of the stretches of marked windows."""
    for rows, data, off in slices(batches):
        w = Words(data, off, NOT_ALNUM, LOWER)
        cover = np.zeros(len(w) + 1, np.int64)
        for k in lengths:
            start = windows(w, k)
            start = start[_marked(sent.value, _names(w.hash, k)[start])] if len(start) else start
            np.add.at(cover, start, 1)
            np.add.at(cover, start + k, -1)
        inside = np.cumsum(cover)[:-1] > 0
        edge = np.ones(len(w), bool)
        edge[1:] = ~inside[:-1] | (w.row[1:] != w.row[:-1])
        begin = np.flatnonzero(inside & edge)
        edge = np.ones(len(w), bool)
        edge[:-1] = ~inside[1:] | (w.row[1:] != w.row[:-1])
        end = np.flatnonzero(inside & edge) + 1
        row = w.row[begin]
        yield pa.RecordBatch.from_arrays([rows.column("uid").take(pa.array(row)), pa.array(begin - w.first[row], pa.int64()), pa.array([w.hash[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())], names=["uid", "first", "words"])


def _many_blocks(items: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """(kept_columns, FOUND) where one automaton can't hold all items."""
    spark = base.sparkSession
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(window)).cast("int").alias("k")).distinct().collect())  # at most ``window`` of them

    def of_items(batches):
        for b in batches:
            words = [np.frombuffer(x, U64) for x in b.column("words").to_pylist()]
            if words:
                yield np.concatenate([_names(x, min(window, len(x))) for x in words])

    sent = spark.sparkContext.broadcast(marks(items.select("words"), of_items))
    met = table(base.select("uid", "text").mapInArrow(lambda it: stretches(it, sent, lengths), "uid long, first long, words binary"))

    def of_stretches(batches):
        for b in batches:
            for x in b.column("words").to_pylist():
                yield np.concatenate([_names(np.frombuffer(x, U64), k) for k in lengths])

    present = spark.sparkContext.broadcast(marks(met.select("words"), of_stretches))

    def occurring(batches):
        for b in batches:
            for item, x in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = np.frombuffer(x, U64)
                k = min(window, len(words))
                at = np.flatnonzero(_marked(present.value, _names(words, k))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.string()), pa.array([words[i : i + k].tobytes() for i in at], pa.binary())], names=["item", "words"])

    chosen = table(items.select("item", "words").mapInArrow(occurring, "item string, words binary").distinct())
    n_blocks = -(-chosen.count() * window // BLOCK_WORDS) * 2
    hits = []
    for b in range(n_blocks):
        mine = chosen.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b).groupBy("words").agg(F.collect_set("item").alias("items")).collect()  # about BLOCK_WORDS / 2 words
        if mine:
            key, block = f"{met.inputFiles()[:1]}{b}", spark.sparkContext.broadcast([(tuple(r["items"]), np.frombuffer(r["words"], U64)) for r in mine])

            def find(batches, key=key, block=block):
                for rows in batches:
                    for uid, first, x in zip(*(rows.column(c).to_pylist() for c in ("uid", "first", "words")), strict=True):
                        words = np.frombuffer(x, U64)
                        w = Words.of(words)
                        hit, items_of = matches(w, *automaton(key, block.value, window))
                        if hit.any():
                            yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([(np.flatnonzero(hit) + first).tolist()], pa.list_(pa.int64())), pa.array([sorted(items_of.get(0, ()))], pa.list_(pa.string()))], names=["uid", "places", "items"])

            hits.append(table(met.mapInArrow(find, "uid long, places array<long>, items array<string>")))
    discard(met, chosen)
    none = spark.createDataFrame([], "uid long, places array<long>, items array<string>")
    every = none
    for h in hits:
        every = every.union(h)
    told = every.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def spelled(batches):
        for rows, data, off in slices(batches):
            w = Words(data, off, NOT_ALNUM, LOWER, hashed=False)
            hit = np.zeros(len(w), bool)
            for r, places in enumerate(rows.column("places").to_pylist()):
                hit[w.first[r] + np.array(places or [], np.int64)] = True
            yield _found(rows, w, off, hit, {r: x for r, x in enumerate(rows.column("items").to_pylist()) if x})

    return base.join(told, "uid", "left").mapInArrow(spelled, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, {FOUND}")


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """The columns keep of docs (but for clashing names), n_words, n_hit, items (sorted as strings) and spans (begin and end byte in the text of each hit stretch)."""
    keep = [c for c in keep if c not in ("n_words", "n_hit", "items", "spans")]
    columns = [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text"]
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), "text").mapInArrow(item_words, "item string, n long, words binary").filter("n > 0")
    if (items.agg(F.sum("n")).first()[0] or 0) > BLOCK_WORDS:
        found = _many_blocks(table(items.distinct()), numbered(docs, columns), window)
        return found.select(*[F.col(f"kept_columns.`{c}`") for c in keep], "n_words", "n_hit", "items", "spans")

    block = [((r["item"],), np.frombuffer(r["words"], U64)) for r in items.select("item", "words").distinct().collect()]  # BLOCK_WORDS words at most
    key = hashlib.sha256(repr([(a, b.tobytes()) for a, b in block] + [window]).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(block)
    base = docs.select(*columns)

    def find(batches):
        for rows, data, off in slices(batches):
            w = Words(data, off, NOT_ALNUM, LOWER)
            hit, of = matches(w, *automaton(key, sent.value, window)) if sent.value else (np.zeros(len(w), bool), {})
            yield _found(rows, w, off, hit, of)

    found = base.mapInArrow(find, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, {FOUND}")
    return found.select(*[F.col(f"kept_columns.`{c}`") for c in keep], "n_words", "n_hit", "items", "spans")


def op3_ahocorasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT u, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT u, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.u, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + k)) AS p FROM h) GROUP BY u),
t AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT u, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (u) LEFT JOIN t USING (u)
"""
