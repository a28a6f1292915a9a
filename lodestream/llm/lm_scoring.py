"""Language-model scores from subword lattices.

The pieces and their first probabilities come from an existing vocabulary file (its path is a
parameter).  A file whose scores are log-probabilities gives them; one whose scores are ranks
(merges of a BPE vocabulary) is read by the Zipf-Mandelbrot law, probability in proportion to
1 / (rank + ``ZIPF``).  A word, with the mark of its beginning, is a lattice of all its segmentations
into pieces; single bytes make one possible for every word.  The forward recursion in log space
adds up all of them.  One expectation step (forward and backward) over the distinct words of the
training rows, each counted once, as the lattice is there for words that come for the first
time, gives the pieces the probabilities they have in the corpus.  ``op9_lattice_lm`` learns from words of any length;
``score`` can be told from how many bytes on words are scored but teach nothing (``teach``, ``LONG_WORD`` if not given).
Words over ``LONG_WORD`` bytes take a way of their own, one by one.

A word that the training rows have is one arc more over its whole lattice: its probability is
(1 - a) * c / N + a * (sum over all segmentations), where c is its count, N all training tokens and a the
share of tokens that are words seen once (Good and Turing's mass of the unseen).  A text's is
the product over its words and an end mark, which is a token like the others.

``score`` also gives a unigram word model as the base: counts of all training
tokens with add-one smoothing, which grow with the corpus.  Both passes work on distinct words of a task.
Word counts meet by 64-bit word hash.  The ``HEAVY`` most frequent words, a table
of fixed size, are broadcast; every other word of a document is sent to the
bucket that holds its count, so no bucket gets more of one word than the rank
after HEAVY has.  Nothing is cut off: words beyond the heavy ones take that way.

Null or empty text: only the end mark.  No training rows: counts are 0.  Repeated rows
are scored, and train, one by one.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange as X
from .folds import fold
from .storage import numbered, table
from .textops import _LETTERS, LOWER, PIECE, SPACE, U64, Words, mix, row_key, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAVY, LONG_WORD, TASK_WORDS, SUMS = 1 << 16, 40, 1_500_000, 16
#: Spelled bytes that a task holds, and the places of a long word that are held at once.
TASK_BYTES, PLACES = 32 << 20, 1 << 16
#: The law's offset, the share of a byte piece and of the end mark against a rank's.
ZIPF, BYTE, END_MARK = 2.7, 1e-9, 1e-3
END = mix(np.array([0x656E64], U64))
#: What each piece has beyond its expected count, if anything was learned.
LEAST = 0.01
#: How often a document has a word, and the log of the sum over its segmentations.
ASKED = np.dtype([("tf", "<i4"), ("lattice", "<f4")])
PARTS = np.dtype([("sum", "<f8"), ("known", "<i4"), ("n", "<i4"), ("lm", "<f8")])


def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings (a blank marks the beginning of a word) and log-probabilities by the file's scores; the end mark is the last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or re.fullmatch(r"<0x..>", text) or model.get_score(i) < -1e8:
            continue
        spelled = text.replace("▁", " ")
        if spelled.rfind(" ") <= 0:
            scores[spelled.encode()] = model.get_score(i)
    ranks = all(x <= 0 and x == int(x) for x in scores.values()) and len(set(scores.values())) == len(scores)
    found = {bytes([b]): BYTE for b in range(256)} | {s: 1 / (ZIPF - x) if ranks else float(np.exp(x)) for s, x in scores.items()}
    p = np.array([*found.values(), END_MARK])
    return list(found), np.log(p / p.sum())


class Lattice:
    """Log marginal probabilities of words given as bytes."""

    def __init__(self, spelled: list[bytes], logp: np.ndarray):
        self.spelled, self.logp = spelled, logp
        self.ids = {s: i for i, s in enumerate(spelled)}
        self.lengths = sorted({len(s) for s in spelled})
        longest = self.lengths[-1]
        self.power = X.powers_of(max(LONG_WORD, longest) + 2)
        self.inverse = X.inverse_powers_of(max(LONG_WORD, longest) + 2)
        self.key = np.array([mix(np.array([np.sum(_LETTERS[np.frombuffer(s, np.uint8)] * self.power[: len(s)], dtype=U64) ^ U64(len(s))]))[0] for s in spelled], U64)
        self.key = np.append(self.key, U64(0))
        self.slots = [np.full(1 << 20, len(spelled), np.int32) for _ in range(4)]
        left = np.arange(len(spelled))
        for k, slot in enumerate(self.slots):  # a piece lies in the first table that has its place free
            at = self._at(self.key[left], k)
            _, one = np.unique(at, return_index=True)
            slot[at[one]] = left[one]
            left = np.delete(left, one)
        if len(left):
            raise ValueError("pieces don't fit the lookup tables")
        self.depth = next(k for k in range(4, 0, -1) if (self.slots[k - 1] < len(spelled)).any())

    @staticmethod
    def _at(key, k):
        return ((key >> U64(11 * k)) & U64((1 << 20) - 1)).astype(np.int64)

    def _find(self, key):
        found = self.slots[0][self._at(key, 0)]
        for k in range(1, self.depth):
            miss = np.flatnonzero(self.key[found] != key)
            if not len(miss):
                break
            found[miss] = self.slots[k][self._at(key[miss], k)]
        return found, self.key[found] == key

    def _group(self, m: np.ndarray, arcs: list | None = None):
        """m: words of one length as rows of bytes, blank first; arcs collects (begin, end, words, pieces)."""
        g, n = m.shape
        sums = np.zeros((n + 1, g), U64)
        np.cumsum(_LETTERS[m.T] * self.power[:n, None], axis=0, out=sums[1:])
        alpha = np.full((n + 1, g), -np.inf)
        alpha[0] = 0
        for e in range(1, n + 1):
            for size in self.lengths:
                if size > e:
                    break
                s = e - size
                key = mix(((sums[e] - sums[s]) * self.inverse[s]) ^ U64(size))
                found, ok = self._find(key)
                at = np.flatnonzero(ok)
                if len(at):
                    alpha[e, at] = np.logaddexp(alpha[e, at], alpha[s, at] + self.logp[found[at]])
                    if arcs is not None:
                        arcs.append((s, e, at, found[at]))
        return alpha if arcs is not None else alpha[n]

    def _one(self, word: bytes):
        """The same for one word, however long."""
        ids, logp, longest = self.ids, self.logp.tolist(), self.lengths[-1]
        recent = [0.0]  # log marginals of the last beginnings, as far back as a piece reaches
        for e in range(1, len(word) + 1):
            found = [recent[-k] + logp[i] for k in range(1, len(recent) + 1) if (i := ids.get(word[e - k : e])) is not None]
            top = max(found)
            recent.append(top + math.log(sum(math.exp(x - top) for x in found)))
            if len(recent) > longest:
                del recent[0]
        return recent[-1]

    def _arcs(self, word: np.ndarray, at: int, to: int):
        """(begins, ends, pieces) by rising ends of the pieces that end behind at, up to to; places count from the first begin that a piece can have."""
        low = max(0, at + 1 - self.lengths[-1])
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(_LETTERS[word[low:to]] * X.powers_of(to - low))))
        inverse = X.inverse_powers_of(to - low + 1)
        some = []
        for size in self.lengths:
            ends = np.arange(max(at + 1 - low, size), to - low + 1)
            found, ok = self._find(mix(((sums[ends] - sums[ends - size]) * inverse[ends - size]) ^ U64(size)))
            some.append((ends[ok] - size, ends[ok], found[ok]))
        begins, ends, piece = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(ends, kind="stable")
        return begins[order], ends[order], piece[order]

    def _onward(self, alpha: list[float], begins: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> list[float]:
        """alpha (log marginals of the first places), carried on over the arcs."""
        alpha, cut = alpha.copy(), np.flatnonzero(np.diff(ends, prepend=-1, append=-1)).tolist()
        begins, logp = begins.tolist(), self.logp[piece].tolist()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            found = [alpha[begins[k]] + logp[k] for k in range(i, j)]
            top = max(found)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in found)))
        return alpha

    def _expected_long(self, word: np.ndarray) -> np.ndarray:
        """How often each piece is expected in one word (blank first), however long: PLACES at once, whose log marginals are found again from those before them on the way back."""
        n, longest = len(word), self.lengths[-1]
        heads, begin = [], [0.0]
        for at in range(0, n, PLACES):
            heads.append(begin)
            begin = self._onward(begin, *self._arcs(word, at, min(at + PLACES, n)))[-longest:]
        out, after = np.zeros(len(self.spelled)), [-begin[-1]]
        for at in range((n - 1) // PLACES * PLACES, -1, -PLACES):
            head = heads.pop()
            begins, ends, piece = self._arcs(word, at, min(at + PLACES, n))
            alpha, logp = self._onward(head, begins, ends, piece), self.logp[piece]
            beta = [-math.inf] * (len(alpha) - len(after)) + after
            for s, e, x in zip(begins[::-1].tolist(), ends[::-1].tolist(), logp[::-1].tolist(), strict=True):  # by falling ends, so beta of an end is complete
                x += beta[e]
                y = beta[s]
                beta[s] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
            out += np.bincount(piece, np.exp(np.array(alpha)[begins] + logp + np.array(beta)[ends]), minlength=len(out))
            after = beta[: len(head)]
        return out

    @staticmethod
    def _matrix(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        m = np.empty((len(starts), n + 1), np.uint8)
        m[:, 0] = 0x20
        m[:, 1:] = data[starts[:, None] + np.arange(n)]
        return m

    def expected(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, over all their segmentations; what has no bytes has none."""
        size, out = ends - starts, np.zeros(len(self.spelled))
        for i in np.flatnonzero(size > LONG_WORD):
            out += self._expected_long(np.append(np.uint8(0x20), data[int(starts[i]) : int(ends[i])]))
        for n in np.unique(size[(size <= LONG_WORD) & (size > 0)]):
            at = np.flatnonzero(size == n)
            for some in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                arcs: list = []
                alpha = self._group(self._matrix(data, starts[some], n), arcs)
                beta = np.full(alpha.shape, -np.inf)
                beta[-1] = -alpha[-1]
                for s, e, mine, piece in reversed(arcs):  # by falling ends, so beta of an end is complete
                    through = self.logp[piece] + beta[e, mine]
                    beta[s, mine] = np.logaddexp(beta[s, mine], through)
                    out += np.bincount(piece, np.exp(alpha[s, mine] + through), minlength=len(out))
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log marginals of the words."""
        size = ends - starts
        out = np.zeros(len(starts))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for some in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                if n <= LONG_WORD:
                    out[some] = self._group(self._matrix(data, starts[some], n))
                else:
                    for i in some:
                        out[i] = self._one(b" " + data[int(starts[i]) : int(ends[i])].tobytes())
        return out


_lattices: dict[str, Lattice] = {}


def _lattice(sent, name: str) -> Lattice:
    if name not in _lattices:
        _lattices.clear()
        _lattices[name] = Lattice(*sent.value)
    return _lattices[name]


class WordStore:
    """Distinct words of a task by hash: their bytes, counts and values; new words come in sorted layers that are merged now and then."""

    def __init__(self):
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys, NaN where unknown."""
        out = np.full(len(keys), np.nan)
        for k, v in self.layers:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            ok = k[at] == keys
            out[ok] = v[at[ok]]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray):
        self.layers.append((keys, values))
        if len(self.layers) > 8 or sum(len(k) for k, _ in self.layers) > TASK_WORDS:
            k, v = (np.concatenate(x) for x in zip(*self.layers, strict=True))
            order = np.argsort(k)
            self.layers = [(k[order], v[order])] if len(k) <= TASK_WORDS else []


COUNTED = "bucket int, keys binary, counts binary, lengths binary, spelled binary"


def _spelled(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of words one after another, taken in pieces of PIECE bytes or of one word."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out, at = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), 0
    while at < len(ends):
        done = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        if to == at + 1:
            out[done : ends[at]] = data[int(starts[at]) : int(starts[at] + lengths[at])]
        else:
            some = lengths[at:to]
            out[done : ends[to - 1]] = data[np.repeat(starts[at:to] - ends[at:to] + some + done, some) + np.arange(int(ends[to - 1]) - done)]
        at = to
    return out


def _merged(held):
    """Sorted distinct words of several lists (keys, counts, lengths, spelled): the counts add up, one spelling stays; and the first of each key in the order of the lists."""
    keys, counts, lengths, spelled = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
    one, starts = order[first], np.cumsum(lengths, dtype=np.int64) - lengths
    return keys[one], np.add.reduceat(counts[order], first) if len(first) else counts, lengths[one], _spelled(spelled, starts[one], lengths[one])


def count_words(batches, n_buckets: int, teach: int | None = LONG_WORD):
    """Packed word counts of the task's training rows, and how the words up to teach bytes are spelled (None: all)."""
    held: list[tuple] = []
    size = spelled_size = 0

    def flush():
        keys, counts, lengths, spelled = _merged(held) if held else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        bucket = (mix(keys ^ X._SALT) % U64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        mine = [(b, order[cut[b] : cut[b + 1]]) for b in range(n_buckets) if cut[b + 1] > cut[b]]
        columns = [[b for b, _ in mine], *([x[at].tobytes() for _, at in mine] for x in (keys, counts, lengths)), [_spelled(spelled, starts[at], lengths[at]).tobytes() for _, at in mine]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "counts", "lengths", "spelled"])

    for rows, data, off in slices(batches):
        data = LOWER[data]
        w = Words(data, off, SPACE)
        keys, one, n = np.unique(w.hash, return_index=True, return_counts=True)
        lengths = (w.ends[one] - w.starts[one]).astype(np.int32)
        if teach is not None:
            lengths[lengths > teach] = 0
        held.append((np.append(keys, END), np.append(n, rows.num_rows).astype(np.int64), np.append(lengths, np.int32(0)), _spelled(data, w.starts[one], lengths)))
        size += len(keys)
        spelled_size += len(held[-1][3])
        if size > TASK_WORDS or spelled_size > TASK_BYTES:
            held = [_merged(held)]
            size, spelled_size = len(held[0][0]), len(held[0][3])
            if size > TASK_WORDS // 2 or spelled_size > TASK_BYTES // 2:
                yield flush()
                held, size, spelled_size = [], 0, 0
    yield flush()


def _sum_counts(batches):
    """One row of sorted distinct words and their counts for each bucket that came here."""
    held: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["bucket"], []).append(tuple(np.frombuffer(r[c], t) for c, t in (("keys", U64), ("counts", np.int64), ("lengths", np.int32), ("spelled", np.uint8))))
    for bucket, some in held.items():
        keys, total, lengths, spelled = _merged(some)
        top = np.sort(total)[-HEAVY:]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (len(keys), total.sum(), (total == 1).sum())), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, total, lengths, spelled)), pa.array([np.bincount(np.log2(top).astype(int), minlength=64).tolist()], pa.list_(pa.int64()))],
            names=["bucket", "n", "total", "once", "keys", "counts", "lengths", "spelled", "sizes"],
        )


def relearned(spark: SparkSession, words: DataFrame, name: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of the file and their log-probabilities after one expectation step over the distinct words; those of the file where there are none."""
    spelled, logp = pieces(name)
    sent = spark.sparkContext.broadcast((spelled, logp))
    width = -(-len(spelled) // SUMS)

    def expect(batches):
        lattice, total = None, np.zeros(SUMS * width)
        for b in batches:
            for lengths, text in zip(b.column("lengths").to_pylist(), b.column("spelled").to_pylist(), strict=True):
                size = np.frombuffer(lengths, np.int32).astype(np.int64)
                ends = np.cumsum(size)
                lattice = lattice or Lattice(*sent.value)
                total[: len(spelled)] += lattice.expected(np.frombuffer(text, np.uint8), ends - size, ends)
        if lattice:
            yield pa.RecordBatch.from_arrays([pa.array(range(SUMS), pa.int32()), pa.array([total[p * width : (p + 1) * width].tobytes() for p in range(SUMS)], pa.binary())], names=["part", "sums"])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                found[p] = found.get(p, 0) + np.frombuffer(x, np.float64)
        for p, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "sums"])

    schema, expected = "part int, sums binary", np.zeros(SUMS * width)
    for r in words.select("lengths", "spelled").mapInArrow(expect, schema).repartitionById(SUMS, F.col("part")).mapInArrow(add, schema).collect():
        expected[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["sums"], np.float64)
    if not expected.any():
        return spelled, logp
    p = expected[: len(spelled)] + LEAST
    return spelled, np.append(np.log(p / p.sum() * (1 - np.exp(logp[-1]))), logp[-1])


def learn(spark: SparkSession, train: DataFrame, n: int, teach: int | None = LONG_WORD):
    """(word counts by bucket of n as a table, N, V, words seen once, heavy words and their counts)."""
    counted = train.select("text").mapInArrow(lambda it: count_words(it, n, teach), COUNTED)
    words = table(counted.repartitionById(n, F.col("bucket")).mapInArrow(_sum_counts, "bucket int, n long, total long, once long, keys binary, counts binary, lengths binary, spelled binary, sizes array<long>"))
    size = words.agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("once").alias("once")).first()
    sizes = np.zeros(64, np.int64)
    for r in words.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        sizes[r["pos"]] = r["n"]
    # the classes 2^k to 2^(k+1) of counts that together hold at most HEAVY words
    above, least = 0, 64
    for k in range(63, -1, -1):
        above += int(sizes[k])
        if above > HEAVY:
            break
        least = k

    def heavy(batches):
        for b in batches:
            for r in b.to_pylist():
                keys, counts = np.frombuffer(r["keys"], U64), np.frombuffer(r["counts"], np.int64)
                ok = counts >= 2.0**least
                yield pa.RecordBatch.from_arrays([pa.array([keys[ok].tobytes()], pa.binary()), pa.array([counts[ok].tobytes()], pa.binary())], names=["keys", "counts"])

    top = words.select("keys", "counts").mapInArrow(heavy, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], U64) for r in top] or [np.zeros(0, U64)])
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in top] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return words, int(size["total"] or 0), int(size["n"] or 0), int(size["once"] or 0), (keys[order], counts[order])


def _mixed(count, lattice, total: int, unseen: float):
    """Log-probabilities of words by their counts and lattices."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log((1 - unseen) * count / max(total, 1)), np.log(unseen) + lattice)


def _score_rows(batches, sent, name: str, heavy, n_buckets: int, total: int, unseen: float):
    """Packed by owner: what a document's own task knows; packed by key: its other words."""
    lattice, (top, top_counts) = _lattice(sent, name), heavy.value
    by_key, by_owner, store = X.Packer(n_buckets), X.Packer(n_buckets, by_owner=True), WordStore()
    for rows, data, off in slices(batches):
        data = LOWER[data]
        w = Words(data, off, SPACE)
        uid = rows.column("uid").to_numpy()
        keys, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        value = store.get(keys)
        new = np.flatnonzero(np.isnan(value))
        if len(new):
            value[new] = lattice.words(data, w.starts[one[new]], w.ends[one[new]]).astype(np.float32)  # as it is sent
            store.put(keys[new], value[new])
        place = np.minimum(np.searchsorted(top, keys), max(len(top) - 1, 0))
        is_top = top[place] == keys if len(top) else np.zeros(len(keys), bool)
        known = is_top[inverse]
        logp = np.log(unseen) + value
        logp[is_top] = _mixed(top_counts[place[is_top]], value[is_top], total, unseen)
        parts = np.zeros(rows.num_rows, PARTS)
        parts["lm"] = np.bincount(w.row, logp[inverse], minlength=rows.num_rows)
        parts["n"] = w.counts + 1
        if known.any():
            parts["sum"] = np.bincount(w.row[known], np.log10(top_counts[place[inverse[known]]] + 1), minlength=rows.num_rows)
            parts["known"] = np.bincount(w.row[known], minlength=rows.num_rows)
        by_owner.add(None, uid, parts)
        pair = row_key(w.row[~known], w.hash[~known])
        _, pick, tf = np.unique(pair, return_index=True, return_counts=True)
        order = np.argsort(pick)
        asked = np.zeros(len(order), ASKED)
        asked["tf"], asked["lattice"] = tf[order], value[inverse[~known][pick[order]]]
        by_key.add(w.hash[~known][pick[order]], uid[w.row[~known][pick[order]]], asked)
        if by_key.full() or by_owner.full():
            yield X.packed_batch(by_key.rows() + by_owner.rows())
    yield X.packed_batch(by_key.rows() + by_owner.rows())


def _look_up(batches, n_buckets: int, total: int, unseen: float):
    """In a bucket: counts of its words, and of the words that documents ask for; answers packed by owner."""
    keys, counts, asked = [], [], []
    for b in batches:
        for told, k, owners, extra in zip(b.column("told").to_pylist(), b.column("keys").to_pylist(), b.column("owners").to_pylist(), b.column("extra").to_pylist(), strict=True):
            if told is None:
                keys.append(np.frombuffer(k, U64))
                counts.append(np.frombuffer(owners, np.int64))
            else:
                asked.append((np.frombuffer(k, U64), np.frombuffer(owners, np.int64), np.frombuffer(extra, ASKED)))
    key = np.concatenate(keys) if keys else np.zeros(0, U64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(key)
    key, count = key[order], count[order]
    pack = X.Packer(n_buckets, by_owner=True)
    for k, owners, tf in asked:
        if not len(k) or not len(key):
            continue
        place = np.minimum(np.searchsorted(key, k), len(key) - 1)
        ok = key[place] == k
        owners, place, tf, lattice = owners[ok], place[ok], tf["tf"][ok], tf["lattice"][ok].astype(np.float64)
        of, at = np.unique(owners, return_inverse=True)
        parts = np.zeros(len(of), PARTS)
        parts["sum"] = np.bincount(at, tf * np.log10(count[place] + 1), minlength=len(of)) if len(of) else 0
        parts["known"] = np.bincount(at, tf, minlength=len(of)) if len(of) else 0
        parts["lm"] = np.bincount(at, tf * (_mixed(count[place], lattice, total, unseen) - np.log(unseen) - lattice), minlength=len(of)) if len(of) else 0  # the lattice alone is at the owner
        pack.add(None, of, parts)
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def _add_up(batches):
    """One row of sums for each document."""
    _, owners, parts = X.unpack(batches, extra=PARTS)
    if len(owners):
        of, at = np.unique(owners, return_inverse=True)
        sums = [np.bincount(at, parts[c], minlength=len(of)) for c in PARTS.names]
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[3])], names=["uid", "base_sum", "n_known", "n_tokens", "lm"])


def score(spark: SparkSession, docs: DataFrame, train: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, teach: int | None = LONG_WORD) -> DataFrame:
    """The columns keep of docs (but for clashing names), n_tokens, n_known, train_tokens, base_score and score (log10); pieces learn from words up to teach bytes (None: all)."""
    n = X.buckets(spark, docs)
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    words, total, distinct, once, heavy = learn(spark, train, n, teach)
    ends = train.count()  # the end mark's count
    unseen = (once + 1) / (total + 1)
    learned = relearned(spark, words, vocabulary)
    end = float(_mixed(ends, learned[1][-1], total, unseen))
    name = f"{vocabulary}#{uuid.uuid4().hex}"  # a worker may have the lattice of another corpus
    sent, top = spark.sparkContext.broadcast(learned), spark.sparkContext.broadcast(heavy)
    base = numbered(docs, [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text"])
    asked = base.select("uid", "text").mapInArrow(lambda it: _score_rows(it, sent, name, top, n, total, unseen), X.PACKED)
    counts = words.select("bucket", F.lit(None).cast("boolean").alias("told"), "n", "keys", F.col("counts").alias("owners"), F.lit(None).cast("binary").alias("extra"))
    dealt = asked.unionByName(counts).repartitionById(n, F.col("bucket"))

    def answer(batches):
        own = []
        for b in batches:
            direct = b.filter(b.column("told").fill_null(False))
            if direct.num_rows:
                yield direct
            own.append(b.filter(pc.invert(b.column("told").fill_null(False))))
        yield from _look_up(own, n, total, unseen)

    sums = X.meet(dealt.mapInArrow(answer, X.PACKED), n).mapInArrow(_add_up, "uid long, base_sum double, n_known long, n_tokens long, lm double")
    norm = float(np.log10(total + distinct + 1))
    return base.drop("text").join(sums, "uid").select(*[F.col(f"kept_columns.`{c}`") for c in keep], "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_sum") + float(np.log10(ends + 1)) - F.col("n_tokens") * norm).alias("base_score"), ((F.col("lm") + end) / float(np.log(10))).alias("score"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold("doc_id", 7) == 2)
    return score(spark, docs, docs.filter(~F.col("held_out")), ["doc_id", "held_out"], teach=None)
