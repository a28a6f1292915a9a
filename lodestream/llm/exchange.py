"""Equal keys of a whole corpus meet in one partition, packed as arrays.

A task that knows many 64-bit keys packs them by target bucket into binary
columns (eight bytes a key and little else), Spark shuffles the few wide rows by
bucket, and the receiving task works on plain arrays.  ``buckets`` grows with the
input, so what one bucket holds stays the same at any scale.  Lost executors cost only the shuffle
blocks they held: Spark recomputes them from the deterministic map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import input_bytes
from .textops import U64, mix, powers, row_key

__all__ = ["NAMED", "PACKED", "Laters", "Packer", "Repeats", "buckets", "by_owner", "inverse_powers_of", "lists", "meet", "packed_batch", "powers_of", "row_key", "told", "unpack"]
PACKED = "bucket int, told boolean, n long, keys binary, owners binary, extra binary"
FLUSH = 750_000
BUCKET_BYTES = 16 << 20
_SALT = U64(0xA24BAED4963EE407)


def buckets(spark: SparkSession, docs: DataFrame) -> int:
    """The session's shuffle partitions, and one at least for each BUCKET_BYTES of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // BUCKET_BYTES))


class Packer:
    """Collects (key, owner, extra) and packs a row for each bucket, which the key decides (by_owner: the owner), when FLUSH of them have come.

    keys or extra may be None throughout, if what is packed has none.
    """

    def __init__(self, n_buckets: int, by_owner: bool = False):
        self.n, self.by_owner, self.parts, self.size = n_buckets, by_owner, [], 0

    def add(self, keys, owners, extra=None):
        self.parts.append((keys, owners, extra))
        self.size += len(owners)

    def full(self) -> bool:
        return self.size >= FLUSH

    def rows(self):
        """A list of packed rows; empties the packer."""
        if not self.size:
            return []
        keys, owners, extra = (None if x[0] is None else np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        bucket = (mix((owners.astype(U64) if self.by_owner else keys) ^ _SALT) % U64(self.n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, owners, extra = (None if x is None else x[order] for x in (keys, owners, extra))
        cut = np.searchsorted(bucket[order], np.arange(self.n + 1))
        bytes_of = lambda x, i, j: b"" if x is None else x[i:j].tobytes()
        return [(b, self.by_owner, int(j - i), bytes_of(keys, i, j), bytes_of(owners, i, j), bytes_of(extra, i, j)) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]


def packed_batch(rows):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[3:])],
        names=["bucket", "told", "n", "keys", "owners", "extra"],
    )


#: The rest of a key of 96 bits, and the place it has at its owner.
NAMED = np.dtype([("second", "<u4"), ("place", "<i4")])


def _groups(keys, *by, second=None):
    """An order by key (and, inside a key, by the last of by first), first flags and group numbers in it; second: the keys' other half."""
    both = (keys,) if second is None else (second, keys)
    order = np.lexsort((*by, *both)) if by or second is not None else np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    if second is not None:
        first[1:] |= second[order][1:] != second[order][:-1]
    return order, first, np.cumsum(first) - 1


class Repeats:
    """Keys that occur twice or more, told to the owners of their occurrences (payload: the "key", or the "place" of NAMED extras, whose second half belongs to the key).

    What one flush of a task already shows to be repeated is told from there, and
    one occurrence goes on for the rest of the corpus: a key that a third of all
    documents have reaches its bucket once for each flush, not for each document.
    """

    def __init__(self, n_buckets: int, payload: str = "key"):
        self.by_key, self.by_owner, self.payload, self.parts, self.size = Packer(n_buckets), Packer(n_buckets, by_owner=True), payload, [], 0

    def add(self, keys, owners, extra=None, twice=None):
        """twice: 1 where the key occurs more than once for this owner."""
        self.parts.append((keys, owners, extra, np.zeros(len(keys), np.int64) if twice is None else twice))
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH

    @staticmethod
    def _tell(pack, keys, owners, extra):
        pack.add(*((keys, owners, None) if extra is None else (None, owners, np.ascontiguousarray(extra["place"]))))

    def rows(self):
        if not self.size:
            return []
        keys, owners, extra, twice = (None if x[0] is None else np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order, first, group = _groups(keys, second=None if extra is None else extra["second"])
        keys, owners, twice = keys[order], owners[order], twice[order]
        extra = None if extra is None else extra[order]
        many = (np.bincount(group) + np.bincount(group, weights=twice)) >= 2
        here = many[group] & ~first
        self._tell(self.by_owner, keys[here], owners[here], None if extra is None else extra[here])
        self.by_key.add(keys[first], owners[first] * 2 + many, None if extra is None else extra[first])
        return self.by_key.rows() + self.by_owner.rows()

    @staticmethod
    def answer(batches, n_buckets: int, payload: str = "key"):
        """In a bucket: packed by owner, what the bucket's keys and the tasks have to tell."""
        own = []
        for b in batches:
            told_rows = b.filter(b.column("told"))
            if told_rows.num_rows:
                yield told_rows
            own.append(b.filter(pc.invert(b.column("told"))))
        keys, owners, extra = unpack(own, extra=np.int32 if payload == "key" else NAMED)
        if len(keys):
            order, _, group = _groups(keys, second=None if payload == "key" else extra["second"])
            keys, owners = keys[order], owners[order]
            many = (np.bincount(group) + np.bincount(group, weights=owners & 1)) >= 2
            ok = many[group]
            pack = Packer(n_buckets, by_owner=True)
            Repeats._tell(pack, keys[ok], owners[ok] >> 1, None if payload == "key" else extra[order][ok])
            yield packed_batch(pack.rows())


PLACE = np.dtype([("order", "<i8"), ("place", "<i4")])


class Laters:
    """Occurrences of a key after its first in the order (order, owner, place), told to their owners as places.

    A flush tells all but its own first occurrence, which goes on to the bucket.
    """

    def __init__(self, n_buckets: int):
        self.by_key, self.by_owner, self.parts, self.size = Packer(n_buckets), Packer(n_buckets, by_owner=True), [], 0

    def add(self, keys, owners, order, place):
        at = np.empty(len(keys), PLACE)
        at["order"], at["place"] = order, place
        self.parts.append((keys, owners, at))
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH

    def rows(self):
        if not self.size:
            return []
        keys, owners, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order, first, _ = _groups(keys, at["place"], owners, at["order"])
        keys, owners, at = keys[order], owners[order], at[order]
        self.by_owner.add(None, owners[~first], np.ascontiguousarray(at["place"][~first]))
        self.by_key.add(keys[first], owners[first], at[first])
        return self.by_key.rows() + self.by_owner.rows()

    @staticmethod
    def answer(batches, n_buckets: int):
        own = []
        for b in batches:
            told_rows = b.filter(b.column("told"))
            if told_rows.num_rows:
                yield told_rows
            own.append(b.filter(pc.invert(b.column("told"))))
        keys, owners, at = unpack(own, extra=PLACE)
        if len(keys):
            order, first, _ = _groups(keys, at["place"], owners, at["order"])
            pack = Packer(n_buckets, by_owner=True)
            pack.add(None, owners[order][~first], np.ascontiguousarray(at["place"][order][~first]))
            yield packed_batch(pack.rows())


def meet(packed: DataFrame, n_buckets: int) -> DataFrame:
    """Deals packed rows out by bucket."""
    return packed.repartitionById(n_buckets, F.col("bucket"))


def unpack(batches, owner=np.int64, extra=np.int32):
    """All (keys, owners, extra) that a receiving task got."""
    keys, owners, extras = [], [], []
    for b in batches:
        keys += [np.frombuffer(x, U64) for x in b.column("keys").to_pylist()]
        owners += [np.frombuffer(x, owner) for x in b.column("owners").to_pylist()]
        extras += [np.frombuffer(x, extra) for x in b.column("extra").to_pylist()]
    if not keys:
        return np.zeros(0, U64), np.zeros(0, owner), np.zeros(0, extra)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(extras)


def by_owner(owners, values):
    """Batches (uid, hits): the values of each owner as one binary."""
    import pyarrow as pa

    order = np.argsort(owners, kind="stable")
    owners, values = owners[order], np.ascontiguousarray(values[order])
    cut = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))) if len(owners) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(owners))
    for at in range(0, len(cut), 10_000):
        some = range(at, min(at + 10_000, len(cut)))
        yield pa.RecordBatch.from_arrays([pa.array(owners[cut[at : at + 10_000]]), pa.array([values[cut[i] : end[i]].tobytes() for i in some], pa.binary())], names=["uid", "hits"])


def lists(column, dtype=np.uint64):
    """Values and their rows of a column of binaries; null has none."""
    values, rows = [], []
    for r, x in enumerate(column.to_pylist()):
        if x:
            v = np.frombuffer(x, dtype)
            values.append(v)
            rows.append(np.full(len(v), r))
    if not values:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(rows)


_INVERSE = U64(pow(int(powers(2)[1]), -1, 1 << 64))
_inverse = np.ones(1, U64)


def powers_of(n: int):
    return powers(max(n, 1))[:n]


def inverse_powers_of(n: int):
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 1 << 18), _INVERSE, dtype=U64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse[:n]


def told(packed: DataFrame, n_buckets: int, extra=None) -> DataFrame:
    """(uid, hits): what rows packed by owner have for each owner, the keys or, with its type, the extra; one row an owner."""

    def group(batches):
        keys, owners, extras = unpack(batches, extra=extra or np.int32)
        yield from by_owner(owners, extras if extra else keys)

    return meet(packed, n_buckets).mapInArrow(group, "uid long, hits binary")
