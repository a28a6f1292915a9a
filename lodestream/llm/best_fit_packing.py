"""Packing of documents into sequences by best-two-fit.

Bins are filled one after another: greedily, always by the longest document that still
fits; then the bin's smallest document is put back if two unpacked documents fill the
space it leaves, with the gap, more tightly than it did, and of all such pairs the fullest is taken.

Lengths lie between 1 and the capacity, so all documents are a histogram of at most
``capacity`` rows.  Bins are formed on it: two documents of one length are the same to
the rule, and while enough of every length is left the next bins are equal to the
last, so a pattern is worked out once and repeated as often as its counts allow.  The
driver's work depends on the number of distinct lengths, not of documents.

Every piece gets its number among all pieces of its length: its place in its task,
counted while the tokens are made, plus what earlier tasks have of that length.  A
length's numbers follow the patterns, so a binary search over their stretches (a
table bounded by the capacity, sent to all tasks) tells the piece's sequence and offset.
No task gets all pieces of a length.

Documents longer than the capacity, and no others, are cut into pieces of it; the last
piece may be shorter.  A null text counts as an empty one, whose only token is the end.  Rows
are packed one by one, whatever their ids; an empty table gives no rows.

Tokens are those of the whole text: the tokenizer file named drops white space, lower-cases, and treats runs of
letters, digits and runs of marks alone, so the distinct ones of a slice are encoded once and put together
again (``by_words``); other files take whole texts.  A single word of many megabytes is
encoded by the library in one piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .storage import table
from .textops import LOWER, SPACE, Words, slices

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Words (and their tokens) that a worker remembers before it starts anew; bytes whose distinct words are looked up at once.
REMEMBERED, POOL, SLICE = 600_000, 6_000_000, 8 << 20
#: A length's place above the bits of a number among its pieces.
NUMBER_BITS = 48


#: Bytes by what the tokenizer makes of them: 0 white space, 1 letters, 2 digits, 3 other marks.
KINDS = np.full(256, 3, np.int8)
KINDS[SPACE] = 0
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = 1
KINDS[0x30:0x3A] = 2
#: Words with these bytes are left whole: beyond ASCII, control characters, apostrophes (short forms) and bars (special tokens).
WHOLE = np.zeros(256, bool)
WHOLE[0x80:] = WHOLE[:0x20] = WHOLE[[0x27, 0x7C, 0x7F]] = True
WHOLE[SPACE] = False


def word_parts(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """What the tokenizer treats alone, and which of it is a part: runs of ASCII letters, lower-cased, single digits, and runs of marks; words with bytes of WHOLE are not cut."""
    words = Words(data, off, hashed=False)
    odd = np.zeros(len(words), bool)
    at = np.flatnonzero(WHOLE[data])
    if len(at):
        odd[np.searchsorted(words.starts, at, side="right") - 1] = True
    kind = KINDS[data]
    uncut = np.zeros(len(data) + 1, np.int8)
    uncut[words.starts[odd]] += 1
    uncut[words.ends[odd]] -= 1
    uncut = np.cumsum(uncut, dtype=np.int8)[:-1].astype(bool)
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1][1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & ~uncut[1:]
    begins[words.starts] = True
    ends = begins.copy()
    ends[words.starts] = False  # where a part follows another
    ends[words.ends] = True
    folded = np.where(uncut, data, LOWER[data])
    parts = Words.at(folded, off, np.flatnonzero(begins), np.flatnonzero(ends))
    return parts, ~uncut[parts.starts] if len(parts) else np.zeros(0, bool)


class WordTokens:
    """Tokens of the words of slices, by a tokenizer that treats words between white space alone and cuts them as ``word_parts`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self):
        self.known, self.flat, self.used = {}, np.empty(1 << 16, np.uint32), 0
        self.begin, self.size = np.empty((2, 1 << 16), np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray):
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        n = len(self.known)
        while n + len(words) > len(self.begin):
            self.begin, self.size = np.concatenate((self.begin, np.empty_like(self.begin))), np.concatenate((self.size, np.empty_like(self.size)))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.begin[n : n + len(words)], self.size[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _learn(self, words: list[bytes], parts: bool):
        """Parts are encoded as one text, in which each is a word of the tokenizer; others one by one."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            if parts:
                e = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
                sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
                if len(sizes) == len(some):
                    self._add(some, np.array(e.ids, np.uint32), sizes)
                    continue
            each = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)]
            self._add(some, np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64))

    def __call__(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the rows, each closed by end, and where rows begin."""
        if len(self.known) > REMEMBERED or self.used > POOL:
            self.forget()
        words, part = word_parts(data, off)
        order, new = words.kinds(by_row=False)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        heads = order[new]
        raw, get = words.raw(), self.known.get
        spelled = [raw[a:b] for a, b in zip(words.starts[heads].tolist(), words.ends[heads].tolist(), strict=True)]
        of = np.array([get(w, -1) for w in spelled], np.int64)
        lacking = np.flatnonzero(of < 0)
        for which in (True, False):
            self._learn([spelled[k] for k in lacking[part[heads[lacking]] == which].tolist()], which)
        of[lacking] = [get(spelled[k]) for k in lacking.tolist()]
        begin, size = self.begin[of][kind], self.size[of][kind]
        ahead = np.concatenate(([0], np.cumsum(size)))
        first = ahead[words.first] + np.arange(len(off))  # a row's end comes before the next row
        out = np.full(first[-1], end, np.uint32)
        at = np.arange(ahead[-1]) + np.repeat(begin - ahead[:-1], size)
        out[np.arange(ahead[-1]) + np.repeat(words.row, size)] = self.flat[at]
        return out, first


class TextTokens:
    """Tokens of whole texts by any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array([*self.tokenizer.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, end], np.uint32) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


@cache
def tokens_of(path: str, by_words: bool) -> WordTokens | TextTokens:
    """One for all tasks of a Python worker, so that words are learned once."""
    return (WordTokens if by_words else TextTokens)(path)


def cut(path: str, capacity: int, end: int, by_words: bool):
    """Pieces of documents; ``place`` is a piece's number among those of its length in its task."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, task = tokens_of(path, by_words), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows, data, off in slices(batches, size=SLICE):
            ids, first = tokens(data, off, end)
            size = np.diff(first)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            begin = first[row] + start
            crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            among = np.empty(len(order), np.int64)
            among[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order], side="left")
            place = seen[length] + among
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [rows.column("kept_columns").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["kept_columns", "piece", "start", "length", "ids_crc32", "task", "place"])

    return run


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, longest first; number of such bins) for counts of each length of at most capacity."""
    left = {k: n for k, n in counts.items() if n}
    lengths, out = sorted(left), []
    while lengths:
        used, gap, at = {}, capacity, len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):
            longest = lengths[at - 1]
            used[longest] = min(left[longest], gap // longest)
            gap -= longest * used[longest]
            at -= 1
        greedy = dict(used)
        smallest = min(used)
        if gap and sum(used.values()) > 1 and (two := tightest_two(lengths, left, used, smallest, smallest + gap)):
            used[smallest] -= 1
            for x in two:
                used[x] = used.get(x, 0) + 1
        need = {k: max(n, greedy.get(k, 0)) for k, n in used.items()}
        times = min((left[k] - need[k]) // n + 1 for k, n in used.items() if n)
        out.append((sorted((k for k, n in used.items() for _ in range(n)), reverse=True), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                del lengths[bisect_right(lengths, k) - 1]
    return out


def tightest_two(lengths: list[int], left: dict[int, int], used: dict[int, int], floor: int, room: int) -> tuple[int, int] | None:
    """The two unpacked documents of the largest sum above floor and within room; of equal sums the one with the longest document."""
    free = np.array([k for k in lengths[: bisect_right(lengths, room)] if left[k] > used.get(k, 0)], np.int64)
    if not len(free):
        return None
    many = np.array([left[k] - used.get(k, 0) > 1 for k in free.tolist()])
    other = np.searchsorted(free, np.minimum(free, room - free), side="right") - 1
    other -= (other == np.arange(len(free))) & ~many  # a length that is left once is no pair with itself
    total = np.where(other >= 0, free + free[other], 0)
    best = int(total.max())
    if best <= floor:
        return None
    at = int(np.flatnonzero(total == best)[-1])
    return int(free[at]), int(free[other[at]])


def stretches(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (key, length, first sequence, copies in a bin, first offset), sorted by key: from which number of a length on pieces lie in which bins."""
    out, ahead, sequence = [], {}, 0
    for bin_, times in patterns:
        at = offset = 0
        while at < len(bin_):
            k = bin_.count(bin_[at])
            length = bin_[at]
            out.append(((length << NUMBER_BITS) + ahead.get(length, 0), length, sequence, k, offset))
            ahead[length] = ahead.get(length, 0) + k * times
            at, offset = at + k, offset + k * length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, keep: list[str], path: str, id_col: str = "doc_id", capacity: int = CAPACITY, end: int = END, by_words: bool = True) -> DataFrame:
    """The columns keep of docs (but for clashing names), piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    keep = [c for c in dict.fromkeys([*keep, id_col]) if c not in names]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text")
    kind = base.schema["kept_columns"].dataType.simpleString()
    pieces = table(base.mapInArrow(cut(path, capacity, end, by_words), f"kept_columns {kind}, piece int, start long, length long, ids_crc32 long, task int, place long"))
    by_task = table(pieces.groupBy("length", "task").count())
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("count")).collect()}  # as many as the capacity at most
    sent = docs.sparkSession.sparkContext.broadcast(stretches(best_two_fit(counts, capacity)))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    ahead = by_task.select("length", "task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ahead"))

    def placed(batches):
        key, _, sequence, copies, offset = sent.value.T
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("place").to_numpy() + b.column("ahead").to_numpy()
            at = np.searchsorted(key, (length << NUMBER_BITS) + number, side="right") - 1
            q = number - (key[at] - (length << NUMBER_BITS))
            columns = [*[b.column(c) for c in ("kept_columns", "piece", "start", "length", "ids_crc32")], pa.array(sequence[at] + q // copies[at]), pa.array(offset[at] + q % copies[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["kept_columns", *names])

    out = pieces.join(ahead, ["length", "task"]).mapInArrow(placed, f"kept_columns {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(*[F.col(f"kept_columns.`{c}`") for c in keep], *names)


def op13_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], public_tokenizers.path(TOKENIZER))
