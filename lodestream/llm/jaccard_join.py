"""Exact n-gram Jaccard self-join with several global token orders.

A document is the set of its ``k``-word shingles.  Sets A and B with
100 |A n B| >= percent |A u B| share a token of their prefixes (n - ceil(percent n / 100) + 1
tokens) under every total order of all tokens.  Two orders are used, which break
ties by different hashes.

1. One pass sums a sketch of document frequencies over all documents (2^20
   counters, a fixed size), and takes the size and two sums of each set.  Equal sets
   are linked by these 128 bits and their size; only the first of them takes part in
   what follows, so copies neither spread tokens nor make others' tokens repeated.
2. Tokens that no other document has come first in every order: they are found by
   exact exchanges, first for a fixed share of all tokens (by hash), then, among the
   documents that this leaves, for the others.  A document whose prefix holds nothing
   else has no link and is done, after either step.
3. The other documents' prefix tokens meet by hash.  Instead of pairs, each token
   links its documents, sorted by size, in chains of compatible sizes, one link a
   document; a task first merges what it has.  Components of these links are
   candidate classes under one order; linked documents lie together under both, so
   the classes are intersected.
4. Classes of up to ``BLOCK`` sets are verified as a
   whole by one sparse product; larger ones first against one block, and then what
   is not yet in the class's largest component against all blocks, so that the
   work grows with what is still undecided, and no task gets more than two blocks.
5. Components of the verified links are the result.

No set is ever stored: what documents hold is read from their texts again, which
are a third as large.  A table is deleted when its last reader is done.

Null or empty text: the empty set, linked with nothing.  Fewer than k words: one
shingle of all words.  A null doc_id is greater than all others.  Repeated rows are
linked documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange as X
from .components import components
from .storage import discard, numbered, table
from .textops import LOWER, SPACE, U64, Words, mix, row_key, shingles, slices

K, PERCENT = 3, 90
SKETCH_BITS, PARTS, BLOCK, SPREAD = 20, 64, 128, 8
ORDERS = (0x1F123BB5, 0x5A17E9C3)


def shingle_sets(data, off, k: int):
    """Distinct shingles of a slice in row order: (rows, hashes, sizes by row)."""
    w = Words(data, off, SPACE, LOWER)
    rows = len(off) - 1
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(rows, np.int64)
    ahead = w.first[w.row + 1] - np.arange(len(w))
    start = np.flatnonzero(ahead >= k)
    row, value = w.row[start], shingles(w.hash, k)[start]
    for n in range(1, k):
        short = w.first[:-1][w.counts == n]
        if len(short):
            row, value = np.append(row, w.row[short]), np.append(value, shingles(w.hash, n)[short])
    _, one = np.unique(row_key(row, value), return_index=True)
    row, value = row[one], value[one]
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    return row, value, np.bincount(row, minlength=rows)


def sums(value, n):
    """Two sums of each row's set, which tell equal sets; what an empty set has means nothing."""
    first = np.cumsum(n) - n
    return [np.add.reduceat(np.append(mix(v), U64(0)), first).view(np.int64) for v in (value, value ^ U64(ORDERS[0]))]


MEASURED = "part int, sketch binary, uids binary, sizes binary, s1 binary, s2 binary"
TAKEN = ("uids", "sizes", "s1", "s2")


def measure(batches, k: int):
    """Document frequencies by sketch counter, and size and sums of each set."""
    sketch, taken = np.zeros(1 << SKETCH_BITS, np.int32), []
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("sketch", *TAKEN))])

    def told():
        return {c: np.concatenate(x).tobytes() for c, x in zip(TAKEN, zip(*taken, strict=True), strict=True)}

    for rows, data, off in slices(batches):
        _, value, n = shingle_sets(data, off, k)
        sketch += np.bincount((value >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
        taken.append((rows.column("uid").to_numpy(), n.astype(np.int32), *sums(value, n)))
        if len(taken) > 64:
            yield pa.RecordBatch.from_pylist([told()], schema=schema)
            taken = []
    out = [told()] if taken else []
    width = len(sketch) // PARTS
    sketch = np.minimum(sketch, 65535).astype(np.uint16)
    out += [{"part": p, "sketch": sketch[p * width : (p + 1) * width].tobytes()} for p in range(PARTS)]
    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in out], schema=schema)


def _add_sketches(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("sketch").to_pylist(), strict=True):
            v = np.frombuffer(x, np.uint16).astype(np.int64)
            total[p] = total[p] + v if p in total else v
    for p, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "sketch"])


def rarity_classes(measured: DataFrame) -> np.ndarray:
    """The class of each sketch counter, 0 for what is not above chance (a fixed size: 2^20 bytes)."""
    parts = measured.filter("sketch is not null").select("part", "sketch").repartitionById(PARTS, F.col("part")).mapInArrow(_add_sketches, "part int, sketch binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(sketch) // PARTS
    for r in parts:
        sketch[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["sketch"], np.int64)
    mean = sketch.mean()
    return np.minimum(15, np.log2(1 + sketch / (mean + 4 * np.sqrt(mean) + 1)).astype(np.uint8))


class Chains:
    """Links of each key's owners whose sizes chain up compatibly, to the least owner of the chain; a task sends one owner of a key and size on."""

    def __init__(self, n_buckets: int, percent: int):
        self.by_key, self.percent, self.parts, self.size = X.Packer(n_buckets), percent, [], 0

    def add(self, keys, owners, sizes):
        self.parts.append((keys, owners, sizes))
        self.size += len(keys)

    @staticmethod
    def links(keys, owners, sizes, percent: int):
        """Links (a, b), and what the order by key, size, owner is."""
        order = np.lexsort((owners, sizes, keys))
        keys, owners, sizes = keys[order], owners[order], sizes[order].astype(np.int64)
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        at = np.flatnonzero(first)
        least = np.minimum.reduceat(owners, at)[np.cumsum(first) - 1] if len(keys) else owners
        other = owners != least
        found = np.unique(np.stack([owners[other], least[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
        return found, order

    def rows(self):
        if not self.size:
            return []
        keys, owners, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        found, order = self.links(keys, owners, sizes, self.percent)
        keys, owners, sizes = keys[order], owners[order], sizes[order]
        on = np.ones(len(keys), bool)
        on[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])
        self.by_key.add(keys[on], owners[on], sizes[on].astype(np.int32))
        told = [(i % self.by_key.n, True, len(some), b"", some[:, 0].tobytes(), some[:, 1].tobytes()) for i, some in enumerate(found[at : at + 50_000] for at in range(0, len(found), 50_000))]
        return self.by_key.rows() + told


def _foremost(value, percent: int):
    """The share of all tokens that comes first: 2.5 times the prefixes' share of a set, a fourth at 90 percent."""
    return mix(value + U64(77)) % U64(max(1, 40 // (100 - percent) if percent < 100 else 40)) == 0


def foremost_tokens(batches, n_buckets: int, k: int, percent: int):
    """Packed (token, document) of the tokens that come first."""
    pack = X.Repeats(n_buckets)
    for rows, data, off in slices(batches):
        row, value, _ = shingle_sets(data, off, k)
        ok = _foremost(value, percent)
        pack.add(value[ok], rows.column("uid").to_numpy()[row[ok]])
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def _flags(row, value, n, rows, known: str, percent: int):
    """Which tokens the column known tells as repeated, prefix lengths, each row's first token."""
    repeated, of = X.lists(rows.column(known))
    told = np.isin(X.row_key(row, value), X.row_key(of, repeated)) if len(repeated) else np.zeros(len(value), bool)
    return told, n - (-(-percent * n // 100)) + 1


LEFT = "uid long, text string, known binary"


def survivors(batches, k: int, percent: int):
    """Documents whose prefix isn't all foremost tokens that no other document has; known: their repeated foremost tokens."""
    for rows, data, off in slices(batches):
        row, value, n = shingle_sets(data, off, k)
        told, length = _flags(row, value, n, rows, "hits", percent)
        n_alone = np.bincount(row[_foremost(value, percent) & ~told], minlength=len(n))
        some = rows.take(pa.array(np.flatnonzero((n > 0) & (n_alone < length))))
        yield pa.RecordBatch.from_arrays([some.column(c) for c in ("uid", "text", "hits")], names=[x.split()[0] for x in LEFT.split(", ")])


def other_tokens(batches, n_buckets: int, k: int, percent: int):
    """Packed (token, document) of the tokens that aren't foremost, of the documents that are left."""
    pack = X.Repeats(n_buckets)
    for rows, data, off in slices(batches):
        row, value, _ = shingle_sets(data, off, k)
        ok = ~_foremost(value, percent)
        pack.add(value[ok], rows.column("uid").to_numpy()[row[ok]])
        if pack.full():
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def prefixed(batches, classes, n_buckets: int, k: int, percent: int):
    """Packed (prefix token, 2 * document + order, size) for both orders, of documents whose prefix has a token of another."""
    pack = Chains(n_buckets, percent)
    for rows, data, off in slices(batches):
        row, value, n = shingle_sets(data, off, k)
        uid = rows.column("uid").to_numpy()
        told, length = _flags(row, value, n, rows, "known", percent)
        more, _ = _flags(row, value, n, rows, "hits", percent)
        head = _foremost(value, percent)
        alone = np.where(head, ~told, ~more)
        open_ = np.bincount(row[alone], minlength=len(n)) < length
        take = open_[row]
        row, value, alone, head = row[take], value[take], alone[take], head[take]
        m = np.where(open_, n, 0)
        first = np.cumsum(m) - m
        rare = classes.value[(value >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64)
        front = (row.astype(U64) << U64(52)) | ((~alone).astype(U64) << U64(51)) | (np.minimum(rare, U64(15)) << U64(47))
        for o, salt in enumerate(ORDERS):
            hashed = mix(value ^ U64(salt))
            order = np.argsort(front | (hashed >> U64(17)))
            at = row[order]  # rows stay in order: the row is the sort key's front
            chosen = order[np.arange(len(at)) - first[at] < length[at]]
            chosen = chosen[~alone[chosen]]
            pack.add(mix(hashed[chosen] + U64(o)), uid[row[chosen]] * 2 + o, n[row[chosen]])
        if pack.size >= X.FLUSH:
            yield X.packed_batch(pack.rows())
    yield X.packed_batch(pack.rows())


def linked(batches, n_buckets: int, percent: int):
    """Packed links (b as key, a as owner) of a bucket's keys and those that tasks found."""
    own, pack = [], X.Packer(n_buckets, by_owner=True)
    for b in batches:
        told = b.filter(b.column("told"))
        for a, c in zip(told.column("owners").to_pylist(), told.column("extra").to_pylist(), strict=True):
            pack.add(np.frombuffer(c, U64), np.frombuffer(a, np.int64))
        own.append(b.filter(X.pc.invert(b.column("told"))))
    keys, owners, sizes = X.unpack(own)
    found, _ = Chains.links(keys, owners, sizes, percent)
    pack.add(found[:, 1].astype(U64), np.ascontiguousarray(found[:, 0]))
    yield X.packed_batch(pack.rows())


def contracted(a: np.ndarray, b: np.ndarray):
    """Links (node, least node that these links connect it with): as many as nodes that aren't least, and no paths longer than one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        for end in (x, y, least[x], least[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    far = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[far], nodes[least[far]]


def distinct_links(batches):
    """(a, b) of a bucket's links, contracted."""
    b, a, _ = X.unpack(batches)
    far, near = contracted(a, b.astype(np.int64))
    for at in range(0, len(far), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(far[at : at + 100_000]), pa.array(near[at : at + 100_000])], names=["a", "b"])


def verified(uids, sets, percent: int):
    """Links (a, b) that span the components of the given sets."""
    size = np.array([len(s) for s in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(ids, minlength=len(tokens)) > 1
    number = np.cumsum(shared) - 1
    ok = shared[ids]
    ids, doc = number[ids[ok]], doc[ok]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 16384):
        some = (ids >= at) & (ids < at + 16384)
        m = np.zeros((len(sets), 16384), np.float32)
        m[doc[some], ids[some] - at] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
    left, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if left[i]:
            left[i] = False
            front = [i]
            while front:
                a = front.pop()
                new = np.flatnonzero(linked[a] & left)
                left[new] = False
                out += [(int(uids[b]), int(uids[a])) for b in new]
                front += new.tolist()
    return out


def verify(rows: DataFrame, n_parts: int, k: int, percent: int) -> DataFrame:
    """Links among the rows (g1, g2, g3, uid, text) of each group (g1, g2, g3), which is of bounded size."""
    dealt = rows.repartition(n_parts, "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3").select("g1", "g2", "g3", "uid", "text")

    def run(batches):
        group, uids, sets = None, [], []

        def done():
            found = verified(uids, sets, percent) if len(uids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for some, data, off in slices(batches):
            _, value, n = shingle_sets(data, off, k)
            cut = np.concatenate(([0], np.cumsum(n)))
            keys = zip(*(some.column(c).to_pylist() for c in ("g1", "g2", "g3")), strict=True)
            for i, (key, uid) in enumerate(zip(keys, some.column("uid").to_pylist(), strict=True)):
                if key != group:
                    if len(uids) > 1:
                        yield done()
                    group, uids, sets = key, [], []
                uids.append(uid)
                sets.append(value[cut[i] : cut[i + 1]])
        yield done()

    return dealt.mapInArrow(run, "a long, b long")


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """rows (uid, key) whose key another row has; the largest key may hold a third of all rows, so each is dealt to SPREAD places."""
    several = rows.groupBy(key).count().filter("count > 1").select(key, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_at"))
    return rows.withColumn("_at", F.pmod(F.xxhash64("uid"), F.lit(SPREAD)).cast("int")).join(several.hint("shuffle_merge"), [key, "_at"]).drop("_at")


def _to_least(rows: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) from each row (uid, key) to the least of its key, by way of the least of its place among SPREAD."""
    placed = rows.select("uid", *key, F.pmod(F.xxhash64("uid"), F.lit(SPREAD)).cast("int").alias("_at"))
    by_place = placed.groupBy(*key, "_at").agg(F.min("uid").alias("rep"))
    least = by_place.groupBy(*key).agg(F.min("rep").alias("least"))
    up = placed.join(by_place, [*key, "_at"]).select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    return up.union(by_place.join(least, key).select(F.col("rep").alias("a"), F.col("least").alias("b"))).filter("a <> b")


def similar_components(spark: SparkSession, docs: DataFrame, keep: list[str], id_col: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The columns keep of docs (but for clashing names), uid, n_shingles and component_uid: equal for documents that links connect (the least uid of them)."""
    n = X.buckets(spark, docs)
    keep = list(dict.fromkeys(c for c in [*keep, id_col] if c not in ("uid", "n_shingles", "component_uid")))
    whole = numbered(docs, [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text"])
    base = whole.select("uid", "text")
    measured = table(base.mapInArrow(lambda it: measure(it, k), MEASURED))
    classes = spark.sparkContext.broadcast(rarity_classes(measured))

    def unpacked(batches):
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in TAKEN], strict=True):
                u, size, s1, s2 = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int32, np.int64, np.int64), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2)], names=["uid", "n_shingles", "s1", "s2"])

    sets = measured.filter("uids is not null").select(*TAKEN).mapInArrow(unpacked, "uid long, n_shingles long, s1 long, s2 long")
    same = table(_to_least(sets.filter("n_shingles > 0"), ["s1", "s2", "n_shingles"]))
    single = base.join(same.select(F.col("a").alias("uid")), "uid", "left_anti")

    known = table(X.told(X.meet(single.mapInArrow(lambda it: foremost_tokens(it, n, k, percent), X.PACKED), n).mapInArrow(lambda it: X.Repeats.answer(it, n), X.PACKED), n))
    left = table(single.join(known, "uid", "left").mapInArrow(lambda it: survivors(it, k, percent), LEFT))
    discard(known)
    more = table(X.told(X.meet(left.mapInArrow(lambda it: other_tokens(it, n, k, percent), X.PACKED), n).mapInArrow(lambda it: X.Repeats.answer(it, n), X.PACKED), n))
    found = table(left.join(more, "uid", "left").mapInArrow(lambda it: prefixed(it, classes, n, k, percent), X.PACKED))
    discard(more)
    by_order = components(X.meet(X.meet(found, n).mapInArrow(lambda it: linked(it, n, percent), X.PACKED), n).mapInArrow(distinct_links, "a long, b long"))
    members = by_order.union(by_order.select(F.col("b").alias("a"), "b").distinct())
    one = members.filter("a % 2 = 0").select(F.shiftright("a", 1).alias("uid"), F.col("b").alias("c0"))
    two = members.filter("a % 2 = 1").select(F.shiftright("a", 1).alias("uid"), F.col("b").alias("c1"))
    classed = one.join(two, "uid").select("uid", F.xxhash64("c0", "c1").alias("class"))
    cand = table(_in_several(classed, "class"))
    discard(found, by_order)
    blocks = cand.groupBy("class").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    reps = cand.join(blocks, "class").select("class", "uid", "nb").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int"))
    reps = table(left.select("uid", "text").join(reps, "uid"))
    discard(left, cand)
    against = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("block"))
    first = verify(reps.select(F.col("class").alias("g1"), F.lit(0).alias("g2"), F.explode(against).alias("g3"), "uid", "text"), n, k, percent)
    links = table(first)

    if reps.filter("nb > 1").limit(1).count():
        large = reps.filter("nb > 1")
        so_far = components(links)
        placed = large.select("uid", "class").join(so_far.select(F.col("a").alias("uid"), F.col("b").alias("c")), "uid", "left").withColumn("c", F.coalesce("c", "uid"))
        sizes = placed.groupBy("class", "c").count()
        main = sizes.groupBy("class").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
        rest = table(placed.join(main, "class").filter("c <> main").select("uid", "class"))
        rest_blocks = rest.groupBy("class").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("rb"))
        undecided = large.join(rest_blocks, "class")
        old = undecided.select(F.col("class").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("g2"), F.col("block").alias("g3"), "uid", "text")
        new = undecided.join(rest.select("uid"), "uid", "left_semi").select(F.col("class").alias("g1"), F.pmod(F.xxhash64("uid", F.lit(1)), F.col("rb")).cast("int").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("g3"), "uid", "text")
        before, links = links, table(so_far.union(verify(old.union(new), n, k, percent)))  # what is connected already is a star by now
        discard(before, so_far, rest)
    discard(reps)
    final = components(links.union(same))
    discard(links, same)

    out = whole.select("uid", *[F.col(f"kept_columns.`{c}`") for c in keep]).join(sets.select("uid", "n_shingles"), "uid").join(final.select(F.col("a").alias("uid"), F.col("b").alias("component_uid")), "uid", "left")
    return out.withColumn("component_uid", F.coalesce("component_uid", "uid"))


def with_least_id(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds component_id, the least id of each component."""
    least = found.groupBy("component_uid").agg(F.min(id_col).alias("component_id"))
    several = found.filter("component_uid <> uid").select("component_uid").distinct().join(least, "component_uid")
    return found.join(several, "component_uid", "left").withColumn("component_id", F.when(F.col("component_id").isNull(), F.col(id_col)).otherwise(F.col("component_id")))


def op4_multiorder_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    found = similar_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return with_least_id(found).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT u, s FROM (SELECT u, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT u, count(*) AS n FROM sh GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.u < b.u GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT u AS a, u AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS u, min(d.doc_id) AS component_id FROM r JOIN d ON d.u = r.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (u) JOIN c USING (u)
"""
