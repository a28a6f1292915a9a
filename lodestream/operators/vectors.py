"""Vector search, theme assignment and monitoring, keywords, and near duplicates by MinHash."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, vectors as V
from ..functions.word_hashes import run_hashes
from ..sources.scratch import table
from .graph import components

# Fixed values
STRONG, WEAK, MERGE, LEARNING_RATE = 0.75, 0.30, 0.85, 0.01
PERMUTATIONS, BANDS = 128, 32
#: As for all near duplicates of word shingles here; 0.85 is another common choice.
SIMILAR, BLOCK = 0.8, 256
#: Centroids and queries that are broadcast at once; more are taken in blocks.
MOST_CENTROIDS, MOST_QUERIES = 20_000, 1_000
#: Rows that meet a block of queries at once.
PIECE = 2_048
#: Bytes of text whose runs of words are hashed at once, and hashes that are permuted at once (they stay in the cache).
TEXT_BYTES, HASHES = 1 << 20, 8_192


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as rows; a null or shorter vector is filled up with zeros."""
    size = max([0, *(x for x in pc.list_value_length(column).to_pylist() if x)])
    if not column.null_count and len(column) and len(flat := column.flatten()) == size * len(column) and not flat.null_count:
        return flat.to_numpy().astype(float).reshape(len(column), size)
    out = np.zeros((len(column), size))
    for r, x in enumerate(column.to_pylist()):
        out[r, : len(x or ())] = [y or 0.0 for y in x or ()]
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _blocks(rows: DataFrame, key: str, vector: str, most: int):
    """(keys, unit vectors) of at most about ``most`` rows each, by hash of the key: what is broadcast at once."""
    n = max(1, -(-rows.count() // most))
    for b in range(n):
        part = sorted(((r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b).select(key, vector).collect()), key=lambda r: r[0])
        if part:
            yield [k for k, _ in part], unit(np.array([v for _, v in part], float))


def _nearest(batches, names: list, q: np.ndarray, limit: int, threshold: float, vector: str, id_col: str) -> list[list[tuple]]:
    """(-similarity, id) of the best rows of each query, in order: ``limit`` for each are held, and those of PIECE rows and one query besides."""
    held: list[list[tuple]] = [[] for _ in names]
    least = np.full(len(names), float(threshold))
    for batch in batches:
        ids, whole = batch.column(id_col).to_pylist(), matrix(batch.column(vector))
        if not ids or whole.shape[1] != q.shape[1]:
            continue
        for start in range(0, len(ids), PIECE):
            c = np.round(q @ unit(whole[start : start + PIECE]).T, 9)
            spots: dict = {}
            for j, k in enumerate(ids[start : start + PIECE]):
                spots.setdefault(k, []).append(j)
            c[:, spots.get(None, [])] = -np.inf  # without an id a row may be the query
            for i, n in enumerate(names):
                if n in spots:
                    c[i, spots[n]] = -np.inf
            for i in np.flatnonzero((c >= least[:, None]).any(axis=1)):
                at = np.flatnonzero(c[i] >= least[i])
                if len(at) > limit:  # equal ones are told apart by id below
                    at = at[c[i, at] >= np.partition(c[i, at], len(at) - limit)[len(at) - limit]]
                held[i] = heapq.nsmallest(limit, held[i] + [(-c[i, j], ids[start + j]) for j in at])
                if len(held[i]) == limit:
                    least[i] = max(least[i], -held[i][-1][0])
    return held


def search(rows: DataFrame, queries: DataFrame, limit: int, threshold: float, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query, id, similarity, rank): the ``limit`` rows most similar to each query (query, vector), at least threshold, itself left out.

    Queries are taken in blocks of a bounded size against all rows: one matrix product a
    batch, of which a task keeps the best of each query.  Similarities count to nine
    decimals, ties by id.
    """
    out = None
    for names, q in _blocks(queries.filter("query is not null"), "query", vector, MOST_QUERIES):
        sent = rows.sparkSession.sparkContext.broadcast((names, q))

        def best(batches, sent=sent):
            names, q = sent.value
            for i, h in enumerate(_nearest(batches, names, q, limit, threshold, vector, id_col)):
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(h)), pa.array([k for _, k in h]), pa.array([-s for s, _ in h], pa.float64())], names=["query", id_col, "similarity"])

        part = rows.select(id_col, vector).mapInArrow(best, f"query {queries.schema['query'].dataType.simpleString()}, {id_col} {rows.schema[id_col].dataType.simpleString()}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select(F.lit(None).cast(queries.schema["query"].dataType).alias("query"), id_col, F.lit(0.0).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), id_col))  # limit rows a task each
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit)


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, centroid (mean by dimension), members."""
    long = rows.select(key, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("members"))


def mean_pooled(tokens: DataFrame, key: str, vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """key, pooled: the mean of a text's token vectors whose mask isn't 0; texts without any have no row."""
    return centroids(tokens.filter(F.col(mask) != 0), key, vector).select(key, F.col("centroid").alias("pooled"))


def assigned(rows: DataFrame, themes: DataFrame, key: str, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """id, nearest theme, similarity and strength (strong, weak, unassigned).

    One matrix product a batch against the broadcast centroids, whose number is
    counted first; more of them are taken in blocks, keeping the best so far.
    """
    out = rows.select(id_col, vector, F.lit(None).cast(themes.schema[key].dataType).alias(key), F.lit(-2.0).alias("similarity"))
    kind = out.schema[key].dataType.simpleString()
    element = out.schema[vector].dataType.simpleString()
    for names, units in _blocks(themes, key, "centroid", MOST_CENTROIDS):
        sent = rows.sparkSession.sparkContext.broadcast((names, units))

        def best(batches, sent=sent):
            names, units = sent.value
            for batch in batches:
                v = matrix(batch.column(vector))
                old, sim = batch.column(key).to_pylist(), batch.column("similarity").to_numpy()
                if batch.num_rows and v.shape[1] == units.shape[1]:
                    c = unit(v) @ units.T
                    k = c.argmax(axis=1)
                    s = c[np.arange(len(k)), k]
                    old = [names[j] if x > y or (x == y and (o is None or names[j] < o)) else o for j, x, y, o in zip(k.tolist(), s.tolist(), sim.tolist(), old, strict=True)]
                    sim = np.maximum(s, sim)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(vector), pa.array(old, batch.column(key).type), pa.array(sim, pa.float64())], names=[id_col, vector, key, "similarity"])

        out = out.mapInArrow(best, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {vector} {element}, {key} {kind}, similarity double")
    strength = F.when(F.col("similarity") >= STRONG, "strong").when(F.col("similarity") >= WEAK, "weak").otherwise("unassigned")
    return out.select(id_col, key, "similarity", strength.alias("strength"))


def merge_candidates(themes: DataFrame, key: str, threshold: float = MERGE) -> DataFrame:
    """Pairs of themes (a < b) whose centroids are as similar as threshold.

    The themes are the stated query set against themselves, in blocks of bounded size.
    """
    kind = themes.schema[key].dataType.simpleString()
    out = None
    for names, units in _blocks(themes, key, "centroid", MOST_CENTROIDS):
        sent = themes.sparkSession.sparkContext.broadcast((names, units))

        def near(batches, sent=sent):
            names, units = sent.value
            for batch in batches:
                own, v = batch.column(key).to_pylist(), matrix(batch.column("centroid"))
                if own and v.shape[1] == units.shape[1]:
                    c = unit(v) @ units.T
                    found = [(own[i], names[j], c[i, j]) for i, j in zip(*np.nonzero(c >= threshold), strict=True) if own[i] < names[j]]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.column(key).type), pa.array([f[1] for f in found], batch.column(key).type), pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "similarity"])

        part = themes.select(key, "centroid").mapInArrow(near, f"a {kind}, b {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else themes.limit(0).select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("similarity"))


def ema_centroids(rows: DataFrame, themes: DataFrame, key: str, order: str, rate: float = LEARNING_RATE, vector: str = "embedding") -> DataFrame:
    """Centroids after the rows have been learned one by one in order: c <- (1 - rate) c + rate x, in closed form.

    The k-th last row counts rate (1 - rate)^k, so it is a weighted sum and needs no fold.
    """
    k = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))) - 1
    weighted = rows.withColumn("_w", F.lit(rate) * F.pow(F.lit(1 - rate), k)).select(key, F.posexplode(vector).alias("i", "x"), "_w")
    moved = weighted.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("_w")).alias("s"), F.count("*").alias("n"))
    old = themes.select(key, F.posexplode("centroid").alias("i", "c"))
    return old.join(moved, [key, "i"], "left").select(key, "i", (F.col("c") * F.pow(F.lit(1 - rate), F.coalesce(F.col("n"), F.lit(0))) + F.coalesce(F.col("s"), F.lit(0.0))).alias("value"))


def stability(rows: DataFrame, themes: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Cosine distance of each theme's centroid and the mean of the rows."""
    now = centroids(rows, key, vector).select(key, F.col("centroid").alias("_now"))
    return themes.join(now, key).select(key, (1 - V.cosine(F.col("centroid"), F.col("_now"))).alias("distance"))


def norm_drift(rows: DataFrame, side: Column, bins: int = 50, vector: str = "embedding", least: int = 10) -> DataFrame:
    """One row: KL divergence of the norms' histograms on side (true: recent) and baseline, null under ``least`` rows a side."""
    n = rows.select(V.norm(F.col(vector)).alias("n"), side.alias("recent"))
    edge = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    placed = n.crossJoin(F.broadcast(edge)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0))  # one row
    hist = placed.groupBy("bin").agg(F.count(F.when(F.col("recent"), 1)).alias("p"), F.count(F.when(~F.col("recent"), 1)).alias("q"))
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(hist, "bin", "left").fillna(0)
    sums = every.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    e = 1e-10
    share = every.crossJoin(F.broadcast(sums)).select("sp", "sq", ((F.col("p") / F.greatest(F.col("sp"), F.lit(1)) + e) / (1 + bins * e)).alias("p"), ((F.col("q") / F.greatest(F.col("sq"), F.lit(1)) + e) / (1 + bins * e)).alias("q"))
    return share.agg(F.when((F.max("sp") >= least) & (F.max("sq") >= least), F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))


def keywords(docs: DataFrame, key: str, limit: int, text: str = "text") -> DataFrame:
    """Top words of each class by class TF-IDF: tf in the class times ln(1 + mean words a class / frequency over all)."""
    words = docs.select(key, F.explode(T.words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    all_ = words.groupBy("word").agg(F.sum("tf").alias("f"))
    size = words.groupBy(key).agg(F.sum("tf").alias("n"))
    mean = size.agg(F.avg("n").alias("mean"))
    scored = words.join(all_, "word").join(size, key).crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") / F.col("n") * F.log(1 + F.col("mean") / F.col("f")))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "word"))).filter(F.col("rank") <= limit).select(key, "word", "score", "rank")


def chunks(docs: DataFrame, size: int, overlap: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Overlapping windows of words: id, chunk number, words."""
    w = T.words(F.col(text))
    start = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 1 - overlap), F.lit(size - overlap))
    return docs.select(id_col, F.posexplode(F.transform(start, lambda i: F.slice(w, i + 1, F.lit(size)))).alias("chunk", "words"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, permutations: int = PERMUTATIONS, seed: int = 7) -> DataFrame:
    """id and MinHash signature over word shingles (all words where there are fewer); no words give no row."""
    a, b = _permutations(permutations, seed)

    def sign(batches):
        for batch in batches:
            texts = batch.column("t").cast(pa.large_string())
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(off, off[start] + TEXT_BYTES, side="right")) - 1)
                values, bounds = run_hashes(texts.slice(start, end - start), words)
                has = np.flatnonzero(np.diff(bounds))
                yield _signed(batch.column(id_col).slice(start, end - start).take(pa.array(has)), id_col, _least(values, np.append(bounds[has], bounds[-1]), a, b))
                start = end

    rows = docs.filter(F.col(text).isNotNull()).select(id_col, F.lower(text).alias("t"))
    return rows.mapInArrow(sign, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, signature array<long>")


def _permutations(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, permutations, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, permutations, dtype=np.uint64)


def _least(values: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each set values[off[r] : off[r + 1]]: its least number in every permutation, -1 throughout for an empty set."""
    out = np.full((len(off) - 1, len(a)), -1, np.int64)
    full = np.flatnonzero(np.diff(off))
    start, at = off[full], 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HASHES)))
        v = values[start[at] : off[full[to - 1] + 1]]
        x, least = np.empty_like(v), np.empty((len(a), to - at), np.uint64)
        for k in range(len(a)):  # one permutation of many sets at once
            np.multiply(v, a[k], out=x)
            x += b[k]
            np.minimum.reduceat(x, start[at:to] - start[at], out=least[k])
        out[full[at:to]] = (least.T >> np.uint64(1)).view(np.int64)
        at = to
    return out


def _signed(ids: pa.Array, id_col: str, rows: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([ids, lists], names=[id_col, "signature"])


def minhashed(hashed: DataFrame, id_col: str, permutations: int = PERMUTATIONS, seed: int = 7) -> DataFrame:
    """id and MinHash signature of sets of hashes (id, h)."""
    a, b = _permutations(permutations, seed)

    def sign(batches):
        for batch in batches:
            column = batch.column("h")
            off = column.offsets.to_numpy().astype(np.int64)
            yield _signed(batch.column(id_col), id_col, _least(column.flatten().to_numpy().view(np.uint64), off - off[0], a, b))

    return hashed.mapInArrow(sign, f"{id_col} {hashed.schema[id_col].dataType.simpleString()}, signature array<long>")


def parts_of(threshold: float, bands: int = BANDS) -> int:
    """How many parts of a signature leave one equal where two are as similar as threshold; no more than there are bands."""
    differing = [k for k in range(PERMUTATIONS) if (PERMUTATIONS - k) / PERMUTATIONS >= threshold]
    return min(bands, len(differing) + (not differing))


def bands_of(signature: str = "signature", parts: int = BANDS) -> Column:
    """Hashes of so many parts of a signature."""
    edge = [b * PERMUTATIONS // parts for b in range(parts + 1)]
    return F.array(*[F.xxhash64(F.lit(b), F.slice(signature, edge[b] + 1, edge[b + 1] - edge[b])) for b in range(parts)])


def _linked(ids: list, m: np.ndarray, threshold: float) -> list[tuple]:
    """Links (a, b) that span the components of ids with signatures m as similar as threshold."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if left[i]:
            left[i] = False
            front = [i]
            while front:
                a = front.pop()
                rest = np.flatnonzero(left)
                new = rest[(m[rest] == m[a]).mean(axis=1) >= threshold]
                left[new] = False
                out += [(ids[b], ids[a]) for b in new]
                front += new.tolist()
    return out


def _groups(batches):
    """Record batches of a group (g1, g2, g3) each, of batches in which the rows of a group follow one another."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        of = np.stack([rows.column(g).to_numpy() for g in ("g1", "g2", "g3")])
        ends = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
        for at, to in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
            yield rows.slice(at, to - at)
        held = rows.slice(ends[-1] if len(ends) else 0)
    if held is not None and held.num_rows:
        yield held


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among the rows (g1, g2, g3, node, signature) of each group (g1, g2, g3), which is of bounded size: a task takes its groups one after another."""

    def run(batches):
        for group in _groups(batches):
            found = _linked(group.column("node").to_pylist(), matrix_of(group.column("signature")), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3").mapInArrow(run, "a long, b long")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Signatures, all of one length, as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def minhash_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, threshold: float = SIMILAR, bands: int = BANDS) -> DataFrame:
    """id, class_id (the least id of the class) of every document with a word.

    Two documents are linked where they share a band and their estimated similarity is
    threshold or more; classes are what links connect.  Equal signatures are one node.
    Bands are as few as leave one equal at the threshold (``parts_of``), and of bands
    that hold the same nodes, told by their number, ends and two sums, one is verified.
    A band's nodes are verified in blocks of ``BLOCK``: all against the first block and their
    own, and then those that aren't in the band's largest component yet against all
    blocks.  No link is lost, and the work grows with what is undecided.
    """
    signed = table(signatures(docs, id_col, text, words).withColumn("hash", F.xxhash64("signature")))
    nodes = table(signed.groupBy("hash", "signature").agg(F.min(id_col).alias("least")).withColumn("node", F.monotonically_increasing_id()))
    buckets = table(nodes.select("node", F.explode(bands_of(parts=parts_of(threshold, bands))).alias("bucket")))
    held = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), *held).filter("n > 1").groupBy("n", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("nb"))
    members = table(buckets.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nb")).cast("int")))
    signature = nodes.select("node", "signature")
    against = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("block"))
    links = table(_verified(members.select(F.col("bucket").alias("g1"), F.lit(0).alias("g2"), F.explode(against).alias("g3"), "node").join(signature, "node"), threshold))
    large = members.filter("nb > 1")
    if large.limit(1).count():
        part = components(links).select(F.col("a").alias("node"), F.col("b").alias("c"))
        placed = large.join(part, "node", "left").withColumn("c", F.coalesce("c", "node"))
        main = placed.groupBy("bucket", "c").count().groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
        rest = table(placed.join(main, "bucket").filter("c <> main").select("bucket", "node"))
        undecided = large.join(rest.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("rb")), "bucket")
        old = undecided.select(F.col("bucket").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("g2"), F.col("block").alias("g3"), "node")
        new = undecided.join(rest, ["bucket", "node"], "left_semi").select(F.col("bucket").alias("g1"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("rb")).cast("int").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("g3"), "node")
        links = links.union(_verified(old.union(new).distinct().join(signature, "node"), threshold))
    found = components(links).select(F.col("a").alias("node"), F.col("b").alias("c"))
    least = nodes.select("node", "least").join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    classes = least.join(least.groupBy("c").agg(F.min("least").alias("class_id")), "c").select("node", "class_id")
    return signed.join(nodes.select("hash", "signature", "node"), ["hash", "signature"]).select(id_col, "node").join(classes, "node").select(id_col, "class_id")
