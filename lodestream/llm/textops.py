"""Vectorised UTF-8 word work on Arrow string buffers, used inside Spark tasks.

All helpers run on one bounded slice of an Arrow batch (``slices``), so the
memory of a task does not depend on how many rows it reads; one document longer
than a slice is a slice of its own.  A null text has no bytes, hence no words.
Word identity is a 64-bit hash of the word's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES, PIECE = 1 << 20, 1 << 18
U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = U64(0xD6E8FEB86659FD93)

IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20
#: Separator bytes of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separator bytes of lower-cased words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _K2
    x = (x ^ (x >> U64(27))) * _K3
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for the ordered pair (a, b)."""
    return mix(a * _K1 + mix(b + U64(salt * 2 + 1)))


_LETTERS = mix(np.arange(1, 257, dtype=U64) * _K1)
#: Letters of a second name that is independent of the first.
_OTHERS = mix(np.arange(1001, 1257, dtype=U64) * _K3)
#: Masks of the first k of eight bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, dtype=U64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), off


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets from 0) of about ``size`` bytes each (SLICE_BYTES, if not given)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + (size or SLICE_BYTES), side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows, at + 4096)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


class Words:
    """The words of a slice: byte starts and ends, row and 64-bit hash of each; ``first`` has each row's first word and at last their number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = IDENTITY, hashed: bool = True):
        n = len(data)
        rows = len(offsets) - 1
        d = fold[data] if fold is not IDENTITY else data
        inside = ~separators[d]
        border = np.zeros(n + 1, dtype=bool)
        border[offsets] = True
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | border[:-1]))
        self.ends = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1), side="left")
        self.counts = np.diff(self.first)
        self._data = d
        if hashed:
            self.hash = self._hash(_LETTERS)

    @classmethod
    def of(cls, names: np.ndarray) -> Words:
        """Words of one row of which only the hashes are known."""
        self = cls.__new__(cls)
        self.hash, self.starts, self.row = names, np.arange(len(names)), np.zeros(len(names), np.int64)
        self.ends, self.first, self.counts = self.starts + 1, np.array([0, len(names)]), np.array([len(names)])
        return self

    @classmethod
    def at(cls, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
        """The words of a slice that lie at starts and ends."""
        self = cls.__new__(cls)
        self.starts, self.ends, self._data = starts, ends, data
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)), side="left")
        self.counts = np.diff(self.first)
        self.hash = self._hash(_LETTERS)
        return self

    def _hash(self, letters: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """Names of the words by a table of letters, in pieces of PIECE bytes: a long text needs no more memory for it than a short one."""
        out = np.empty(len(self), U64)
        size = self.ends - self.starts
        total = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, side="right")) - 1)
            begin = total[at:to] - total[at]
            inside = np.arange(total[to] - total[at]) - np.repeat(begin, size[at:to])
            d = self._data[inside + np.repeat(self.starts[at:to], size[at:to])]
            terms = letters[d if fold is None else fold[d]] * powers(int(size[at:to].max()))[inside]
            out[at:to] = mix(np.add.reduceat(terms, begin) + size[at:to].astype(U64) * _K1)
            at = to
        return out

    def folded(self, fold: np.ndarray = LOWER) -> np.ndarray:
        """The hashes that the words have with their bytes folded (fold keeps separators and lengths)."""
        return self._hash(_LETTERS, fold)

    def second(self) -> np.ndarray:
        """Independent hashes of the words."""
        return self._hash(_OTHERS)

    def prefix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of k bytes or more and hashes of their first k bytes, which differ from the hashes of words."""
        at = np.flatnonzero(self.ends - self.starts >= k)
        total, p = np.zeros(len(at), U64), powers(k)
        for j in range(k):
            total += _LETTERS[self._data[self.starts[at] + j]] * p[j]
        return at, mix(total + U64(k * int(_K3) % (1 << 64)))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a and b have the same bytes, compared eight at a time."""
        size = self.ends - self.starts
        out = size[a] == size[b]
        left, at = np.flatnonzero(out), 0
        if len(left):
            padded = np.concatenate((self._data, np.zeros(8, np.uint8)))
            eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        while len(left):
            x, y = a[left], b[left]
            rest = np.minimum(size[x] - at, 8)
            differ = (eights[self.starts[x] + at] ^ eights[self.starts[y] + at]) & _FIRST[rest] != 0
            out[left[differ]] = False
            left, at = left[~differ & (size[x] > at + 8)], at + 8
        return out

    def kinds(self, by_row: bool) -> tuple[np.ndarray, np.ndarray]:
        """An order of the words (of each row, or all) by hash, and whether each has other bytes than those before it in that order.

        Words of one hash lie together.  Their bytes are compared, so a hash that two words
        share makes two kinds of them.
        """
        order = np.argsort(self.hash, kind="stable")
        if by_row and len(self.first) > 2:
            row = self.row.astype(np.uint16) if len(self.first) <= 1 << 16 else self.row
            order = order[np.argsort(row[order], kind="stable")]
        new = np.ones(len(order), dtype=bool)
        if len(order) > 1:
            h, r = self.hash[order], self.row[order]
            new[1:] = h[1:] != h[:-1]
            if by_row:
                new[1:] |= r[1:] != r[:-1]
            again = np.flatnonzero(~new)
            odd = again[~self.equal(order[again - 1], order[again])]
            heads = np.append(np.flatnonzero(new), len(new))
            for at in np.unique(np.searchsorted(heads, odd, side="right") - 1).tolist():  # a shared hash
                begin, end = heads[at], heads[at + 1]
                run = sorted(order[begin:end].tolist(), key=self.bytes_of)
                order[begin:end] = run
                new[begin + 1 : end] = [self.bytes_of(x) != self.bytes_of(y) for x, y in zip(run, run[1:], strict=False)]
        return order, new

    def raw(self) -> bytes:
        """The bytes that starts and ends count in."""
        return self._data.tobytes()

    def bytes_of(self, word: int) -> bytes:
        return self._data[self.starts[word] : self.ends[word]].tobytes()

    def __len__(self):
        return len(self.starts)


def windows(words: Words, k: int) -> np.ndarray:
    """Indices of the words at which k words of one row start."""
    left = words.first[words.row + 1] - np.arange(len(words))
    return np.flatnonzero(left >= k)


def shingles(values: np.ndarray, k: int) -> np.ndarray:
    """Names of the k values that start at each position (k - 1 fewer than values)."""
    if len(values) < k:
        return np.zeros(0, dtype=U64)
    n = len(values) - k + 1
    total = np.zeros(n, dtype=U64)
    p = powers(k)
    for j in range(k):
        total += values[j : j + n] * p[j]
    return mix(total ^ U64(k))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by row; values lie in the order of rows that start at first."""
    c = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return c[first[1:]] - c[first[:-1]]


def row_key(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values made distinct by row."""
    return mix(values + mix(row.astype(U64) + _K1))
