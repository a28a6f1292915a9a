"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram of common words are
compared with those of every language's reference by Jensen-Shannon divergence
(base 2, 0 to 1).  A document passes if for one language both lie within their
limits; a histogram of n items is granted ``GUARD * (bins - 1) / n`` more, the
order of a short text's own sampling error, and texts below ``MIN_WORDS`` words
fail before any comparison.

References are sums over all documents with a language that pass the base rules,
gathered in two passes: 9 character classes and 2^13 hashed word buckets per
language, and then the words of the fullest buckets, of which the ``COMMON`` most frequent are
the common words.  A word can't be more frequent than its bucket, so once the least of them
is as frequent as the fullest bucket that wasn't read they are exact; else more
buckets are read.  What the driver gets depends on the number of languages only.  Every
language with a document gives a reference, however few there are.  A reference of
d documents and m items is itself a sample: against their own language's, documents
are granted ``GUARD * (bins - 1) / m`` more and limits wider by 1 / d.  Documents of
other languages are not, so a small reference lets nothing foreign pass.

Null text: no words, base_failed.  Null lang: not in a reference, judged like
others.  Without any reference (an empty table, no languages) the base rules
decide alone.  Repeated rows and ids are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .textops import NEWLINE, PIECE, SPACE, U64, Words, mix, row_key, shingles, slices

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
BUCKETS, COMMON, FULLEST = 1 << 13, 32, 128
CHAR_LIMIT, WORD_LIMIT, GUARD = 0.06, 0.20, 0.5
SYMBOLS = b"#*$%&|<>"

#: Classes of UTF-8 bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 symbols, 7 other ASCII, 8 beyond ASCII, 9 not counted.
CLASSES = np.full(256, 7, dtype=np.int64)
CLASSES[0x61:0x7B], CLASSES[0x41:0x5B], CLASSES[0x30:0x3A] = 0, 1, 2
CLASSES[[0x20, 9, 11, 12]], CLASSES[[10, 13]] = 3, 4
CLASSES[list(b".,;:'\"?!()-")], CLASSES[list(SYMBOLS)] = 5, 6
CLASSES[0xC0:], CLASSES[0x80:0xC0] = 8, 9
N_CLASSES = 9
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: First bytes of a word's code points.
_IN_WORD = ~SPACE
_IN_WORD[0x80:0xC0] = False


def base_counts(data, off):
    """words, and by row: word_chars, n_symbols, n_dup_lines, n_repeat_words; and the classes by row."""
    words = Words(data, off, SPACE)
    rows = len(off) - 1
    word_chars, n_symbols, classes = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros((rows, 10), np.int64)
    for at in range(0, len(data), PIECE):  # bounded memory, however long a text is
        d = data[at : at + PIECE]
        of = np.searchsorted(off, np.arange(at, at + len(d)), side="right") - 1
        word_chars += np.bincount(of[_IN_WORD[d]], minlength=rows)
        n_symbols += np.bincount(of[_IS_SYMBOL[d]], minlength=rows)
        classes += np.bincount(of * 10 + CLASSES[d], minlength=rows * 10).reshape(rows, 10)
    classes = classes[:, :N_CLASSES]

    lines = Words(data, off, NEWLINE)
    has_word = np.zeros(len(lines), bool)
    if len(lines):
        filled = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)))
        has_word = filled[lines.ends] > filled[lines.starts]
    key = row_key(lines.row, lines.hash)[has_word]
    line_rows = lines.row[has_word]
    _, one = np.unique(key, return_index=True)
    n_dup_lines = np.bincount(line_rows, minlength=rows) - np.bincount(line_rows[one], minlength=rows)

    at = np.flatnonzero(words.first[words.row + 1] - np.arange(len(words)) >= 3) if len(words) else np.zeros(0, np.int64)
    covered = np.zeros(len(words), bool)
    if len(at):
        key = row_key(words.row[at], shingles(words.hash, 3)[at])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for j in range(3):
            covered[at[again] + j] = True
    n_repeat = np.bincount(words.row[covered], minlength=rows) if len(words) else np.zeros(rows, np.int64)
    return words, word_chars, n_symbols, n_dup_lines, n_repeat, classes


def _failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)


def _bucket(folded: np.ndarray) -> np.ndarray:
    return (mix(folded + U64(7)) % U64(BUCKETS)).astype(np.int64)


def reference_sums(batches):
    """(lang, feature, n): class c is feature -1-c, bucket b is feature b, documents are feature -100."""
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, v in held.items():
            at = np.flatnonzero(v)
            feature = np.where(at < BUCKETS, at, np.where(at < BUCKETS + N_CLASSES, BUCKETS - 1 - at, -100))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(feature, pa.int64()), pa.array(v[at], pa.int64())], names=["lang", "feature", "n"])
        held.clear()

    for rows, data, off in slices(batches):
        words, _, _, _, n_repeat, classes = base_counts(data, off)
        bucket = _bucket(words.folded())
        ok = ~_failed(words.counts, n_repeat)
        langs = np.array(rows.column("lang").to_pylist(), dtype=object)
        for lang in {x for x in langs if x is not None}:
            mine = (langs == lang) & ok
            if mine.any():
                v = held.setdefault(lang, np.zeros(BUCKETS + N_CLASSES + 1, np.int64))
                v[:BUCKETS] += np.bincount(bucket[mine[words.row]], minlength=BUCKETS)
                v[BUCKETS:-1] += classes[mine].sum(axis=0)
                v[-1] += int(mine.sum())
        if len(held) > 200:
            yield from flush()
    yield from flush()


def word_counts(batches, wanted: dict[str, np.ndarray]):
    """(lang, word, n): words (64-bit names) in the buckets that wanted flags for the language, of documents that pass the base rules."""
    held: dict[str, list] = {}

    def flush():
        for lang, some in held.items():
            words, n = (np.concatenate(x) for x in zip(*some, strict=True))
            one, at = np.unique(words, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one.view(np.int64)), pa.array(np.bincount(at, n, len(one)).astype(np.int64))], names=["lang", "word", "n"])
        held.clear()

    size = 0
    for rows, data, off in slices(batches):
        words, _, _, _, n_repeat, _ = base_counts(data, off)
        folded = words.folded()
        bucket, ok = _bucket(folded), ~_failed(words.counts, n_repeat)
        langs = np.array(rows.column("lang").to_pylist(), dtype=object)
        for lang in {x for x in langs if x in wanted}:
            mine = folded[((langs == lang) & ok)[words.row] & wanted[lang][bucket]]
            held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
            size += len(held[lang][-1][0])
        if size > 1_000_000:
            yield from flush()
            size = 0
    yield from flush()


def references(docs: DataFrame):
    """[(lang, class shares, common words, their shares and at last the rest's, (documents, characters, words))], by lang."""
    docs = docs.select("lang", "text")
    found = docs.mapInArrow(reference_sums, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()  # up to BUCKETS + 10 rows a language
    sums_of: dict[str, np.ndarray] = {}
    for r in found:
        v = sums_of.setdefault(r.lang, np.zeros(BUCKETS + N_CLASSES + 1))
        v[r.feature if r.feature >= 0 else -1 if r.feature == -100 else BUCKETS - 1 - r.feature] = r.n
    common: dict[str, list] = {}
    open_, fullest = dict(sums_of), FULLEST
    while open_:
        order = {x: np.argsort(-v[:BUCKETS], kind="stable") for x, v in open_.items()}
        wanted = {x: np.isin(np.arange(BUCKETS), o[:fullest]) for x, o in order.items()}
        counted = docs.mapInArrow(lambda it, wanted=wanted: word_counts(it, wanted), "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top: dict[str, list] = {x: [] for x in open_}
        for r in counted.withColumn("place", first).filter(F.col("place") <= COMMON).collect():
            top[r.lang].append((r.word, r.n))
        for x, words in top.items():
            beyond = open_[x][order[x][fullest]] if fullest < BUCKETS else 0
            if not beyond or (len(words) == COMMON and min(n for _, n in words) >= beyond):
                common[x] = words
        open_, fullest = {x: v for x, v in open_.items() if x not in common}, fullest * 4
    out = []
    for name, v in sorted(sums_of.items()):
        classes, n_words = v[BUCKETS:-1], v[:BUCKETS].sum()
        words = np.array([w for w, _ in common[name]], np.int64).view(U64)
        order = np.argsort(words)
        shares = np.array([n for _, n in common[name]])[order] / n_words
        out.append((name, classes / classes.sum(), words[order], np.append(shares, max(0.0, 1 - shares.sum())), (int(v[-1]), int(classes.sum()), int(n_words))))
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """By row of p, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.clip((a + b) / 2, 0, 1)


def divergences(refs, words, folded, classes, rows, langs):
    """By row: least of the languages' worst excess over its limit, that language, its two divergences."""
    n_chars = np.maximum(classes.sum(axis=1), 1)
    n_words = np.maximum(words.counts, 1)
    best, which = np.full(rows, np.inf), np.full(rows, -1)
    char_js, word_js = np.full(rows, np.nan), np.full(rows, np.nan)
    known = np.unique(np.concatenate([r[2] for r in refs])) if refs else np.zeros(0, U64)
    at = np.minimum(np.searchsorted(known, folded), max(len(known) - 1, 0))
    at = np.where(known[at] == folded, at, len(known)) if len(known) else np.zeros(len(folded), np.int64)
    for k, (name, ref_classes, common, shares, (ref_docs, ref_chars, ref_words)) in enumerate(refs):
        own = (langs == name).astype(float)
        place = np.full(len(known) + 1, len(common))
        place[np.searchsorted(known, common)] = np.arange(len(common))
        hist = np.bincount(words.row * (len(common) + 1) + place[at], minlength=rows * (len(common) + 1)).reshape(rows, -1)
        c = jensen_shannon(classes / n_chars[:, None], ref_classes)
        w = jensen_shannon(hist / n_words[:, None], shares)
        wider = 1 + own / ref_docs
        over = np.maximum((c - GUARD * (N_CLASSES - 1) * (1 / n_chars + own / ref_chars)) / (CHAR_LIMIT * wider), (w - GUARD * len(common) * (1 / n_words + own / ref_words)) / (WORD_LIMIT * wider))
        better = over < best
        best, which = np.where(better, over, best), np.where(better, k, which)
        char_js, word_js = np.where(better, c, char_js), np.where(better, w, word_js)
    return best, which, char_js, word_js


QUALITY = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest_lang string, char_js double, word_js double"


def score(docs: DataFrame, keep: list[str], refs=None) -> DataFrame:
    """The columns keep of docs (but for clashing names) and QUALITY's; docs has text and, to learn references where none are given and to know a document's own, lang."""
    refs = references(docs) if refs is None else refs
    names = np.array([r[0] for r in refs] + [None], dtype=object)
    keep = [c for c in keep if c not in {x.split()[0] for x in QUALITY.split(", ")}]
    base = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))

    def judge(batches):
        for rows, data, off in slices(batches):
            words, word_chars, n_symbols, n_dup, n_repeat, classes = base_counts(data, off)
            failed = _failed(words.counts, n_repeat)
            best, which, c, w = divergences(refs, words, words.folded(), classes, rows.num_rows, np.array(rows.column("lang").to_pylist(), dtype=object))
            kept = ~failed & ((best <= 1) | (not refs))
            yield pa.RecordBatch.from_arrays(
                [rows.column("kept_columns"), *(pa.array(x, pa.int64()) for x in (words.counts, word_chars, n_symbols, n_dup, n_repeat)), pa.array(failed), pa.array(kept), pa.array(names[which].tolist(), pa.string()), pa.array(c), pa.array(w)],
                names=["kept_columns", *(x.split()[0] for x in QUALITY.split(", "))],
            )

    return base.mapInArrow(judge, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, {QUALITY}").select(*[F.col(f"kept_columns.`{c}`") for c in keep], *(x.split()[0] for x in QUALITY.split(", ")))


def op8_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
