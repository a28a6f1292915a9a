"""How the set of themes changes: similar ones merge, outliers found new ones.

Merging is greedy, the most similar pair first (ties by ids): the theme with more documents takes
the other in, its count grows, what was taken in merges no more.  A pair can be decided as soon as it
comes first of all undecided pairs of both its themes, as nothing before it touches them; so a round decides every
such pair at once, and the result is that of the sequential order.

New themes are the density clusters of documents outside all themes, unless a cluster's mean is as similar to a
standing theme as ``NEW``; standing themes are left as they are.  Keywords are words and pairs of words by
summed, length-normalised TF-IDF in the cluster.  All of them are counted by 64-bit hashes, and spelled and counted
anew only where a hash is among the most frequent of its cluster, all that tie with the last of these included.  Two
terms below these that share a hash and together come among them, which would cost the last one its place, are not to be
expected in 64 bits.

Null ids and vectors don't cluster; null texts have no keywords, and a cluster without any is named by the
word unknown.  Repeated ids count each.  Empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..sources.scratch import discard, table
from .density import density_clusters
from .keywords import STOP
from .vectors import assigned, centroids

# Fixed values
NEW, TOP_WORDS, FEATURES, LEAST = 0.30, 10, 1000, 10
#: Hashes that tasks are sent to tell frequent terms by; of more, every term is spelled.
MOST_SENT = 200_000
#: Words of a slice.
TOKENS = 1_000_000


def greedy_merges(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """absorbed, survivor, similarity of the merges of themes (theme, n) along pairs (a < b, similarity)."""
    now = table(pairs.select("a", "b", "similarity", F.struct((-F.col("similarity")).alias("s"), "a", "b").alias("at")))
    sizes = table(counts.select("theme", "n"))
    out = None
    while now.limit(1).count():
        ends = now.select(F.col("a").alias("theme"), "at").union(now.select("b", "at"))
        first = ends.groupBy("theme").agg(F.min("at").alias("first"))
        of = lambda end: first.select(F.col("theme").alias(end), F.col("first").alias(f"first_{end}"))
        n = lambda end: sizes.select(F.col("theme").alias(end), F.col("n").alias(f"n_{end}"))
        decided = now.join(of("a"), "a").join(of("b"), "b").filter("at = first_a and at = first_b").join(n("a"), "a").join(n("b"), "b")
        larger = F.col("n_a") >= F.col("n_b")
        merges = table(decided.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("absorbed"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("survivor"), "similarity", (F.col("n_a") + F.col("n_b")).alias("n")))
        out = merges if out is None else out.union(merges)
        gone = merges.select("absorbed")
        grown = merges.select(F.col("survivor").alias("theme"), F.col("n").alias("_n"))
        old = now, sizes
        sizes = table(sizes.join(gone.withColumnRenamed("absorbed", "theme"), "theme", "left_anti").join(grown, "theme", "left").select("theme", F.coalesce("_n", "n").alias("n")))
        now = table(now.join(gone.withColumnRenamed("absorbed", "a"), "a", "left_anti").join(gone.withColumnRenamed("absorbed", "b"), "b", "left_anti").select("a", "b", "similarity", "at"))
        discard(*old)
    if out is None:
        return pairs.select(F.col("b").alias("absorbed"), F.col("a").alias("survivor"), "similarity").limit(0)
    return out.drop("n")


def final_survivors(merges: DataFrame) -> DataFrame:
    """theme, survivor: where each absorbed theme ends up, by doubling steps."""
    up = table(merges.select(F.col("absorbed").alias("theme"), "survivor"))
    while True:
        above = up.select(F.col("theme").alias("survivor"), F.col("survivor").alias("_to"))
        joined = up.join(above, "survivor", "left")
        if not joined.filter("_to is not null").limit(1).count():
            return up
        last, up = up, table(joined.select("theme", F.coalesce("_to", "survivor").alias("survivor")))
        discard(last)


def merged_themes(themes: DataFrame, words: DataFrame, merges: DataFrame, key: str = "theme", top: int = TOP_WORDS) -> DataFrame:
    """The themes that are left: key, centroid (weighted by n), n, merged_from, words (the best score of each word, the ``top`` best).

    themes: key, centroid, n; words: key, word, score.
    """
    into = final_survivors(merges).select(F.col("theme").alias(key), "survivor")
    placed = themes.join(into, key, "left").withColumn("survivor", F.coalesce("survivor", key))
    mean = placed.select("survivor", "n", F.posexplode("centroid").alias("i", "x")).groupBy("survivor", "i").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x"))
    centre = mean.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))  # a theme's dimensions
    sums = placed.groupBy("survivor").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col(key) != F.col("survivor"), F.col(key)))).alias("merged_from"))
    best = words.join(into, key, "left").groupBy(F.coalesce("survivor", key).alias("survivor"), "word").agg(F.max("score").alias("score"))
    kept = best.withColumn("at", F.row_number().over(W.partitionBy("survivor").orderBy(F.desc("score"), "word"))).filter(F.col("at") <= top)
    listed = kept.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word", "score"))), lambda s: F.struct(s["word"].alias("word"), s["score"].alias("score"))).alias("words"))  # top words
    return centre.join(sums, "survivor").join(listed, "survivor", "left").withColumnRenamed("survivor", key)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, the row, first word and code of each term, how many of the terms are words) of slices of rows with hashed words h and a hashed key; pairs come after the words."""
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
    for batch in batches:
        lists = batch.column("h")
        off, start = lists.offsets.to_numpy().astype(np.int64), 0
        keys = batch.column("hashed_key").to_numpy().view(np.uint64)
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + TOKENS, side="right")) - 1)
            h = lists.values.slice(off[start], off[end] - off[start]).to_numpy().view(np.uint64)
            row = np.repeat(np.arange(end - start), np.diff(off[start : end + 1]))
            pair = np.flatnonzero(row[1:] == row[:-1])
            mixed = h[pair] * a + h[pair + 1] * b
            at = np.concatenate([np.arange(len(h)), pair])
            code = np.concatenate([h, mixed ^ (mixed >> np.uint64(29))]) ^ keys[start:end][row[at]]
            code *= c
            yield batch.slice(start, end - start), row[at], at, code ^ (code >> np.uint64(32)), len(h)
            start = end


def tfidf_keywords(docs: DataFrame, key: str, id_col: str, text: str = "text", top: int = TOP_WORDS, features: int = FEATURES, stop: frozenset[str] = STOP) -> DataFrame:
    """key, word, score, rank: the ``top`` words and pairs of words of each group by the sum of its documents' normalised TF-IDF."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    kept = F.filter(found, lambda w: ~w.isin(*sorted(stop))) if stop else found
    kind = docs.schema[key].dataType.simpleString()
    given = docs.filter(F.col(key).isNotNull())
    # a variable of a lambda, so that the words are cut once for themselves and their hashes
    both = F.transform(F.array(F.coalesce(kept, F.array().cast("array<string>"))), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))[0]
    rows = given.select(F.col(key).alias("key"), F.xxhash64(key).alias("hashed_key"), both.alias("both"))

    def counted(batches):
        for part, row, _, code, _ in _coded(batches):
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
            yield pa.RecordBatch.from_arrays([part.column("hashed_key").take(pa.array(row[order[first]])), pa.array(code[first].view(np.int64)), pa.array(np.diff(np.append(first, len(code))))], names=["hashed_key", "code", "n"])

    totals = rows.select("hashed_key", "both.h").mapInArrow(counted, "hashed_key long, code long, n long").groupBy("hashed_key", "code").agg(F.sum("n").alias("total"))
    frequent = table(totals.withColumn("_at", F.rank().over(W.partitionBy("hashed_key").orderBy(F.desc("total")))).filter(F.col("_at") <= features).select("code"))
    few = frequent.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64)) if few else None)  # MOST_SENT numbers

    def spelled(batches):
        able = sent.value
        for part, row, at, code, singles in _coded(batches):
            if able is None:
                taken = np.arange(len(at))
            elif len(able):
                taken = np.flatnonzero(able[np.minimum(np.searchsorted(able, code), len(able) - 1)] == code)
            else:
                taken = np.zeros(0, np.int64)
            words, one = part.column("w").flatten(), at[taken[taken < singles]]
            two = at[taken[taken >= singles]]
            terms = pa.concat_arrays([words.take(pa.array(one)), pc.binary_join_element_wise(words.take(pa.array(two)), words.take(pa.array(two + 1)), " ")]).dictionary_encode()
            size = max(1, len(terms.dictionary))
            kinds, tf = np.unique(row[taken] * size + terms.indices.to_numpy(), return_counts=True)
            of = pa.array(kinds // size)
            yield pa.RecordBatch.from_arrays([part.column("key").take(of), part.column("doc").take(of), terms.dictionary.take(pa.array(kinds % size)), pa.array(tf.astype(np.int64))], names=["key", "doc", "word", "tf"])

    # a document's terms come from one slice, so nothing is counted across rows
    tf = table(rows.select("key", "hashed_key", F.monotonically_increasing_id().alias("doc"), "both.w", "both.h").mapInArrow(spelled, f"key {kind}, doc long, word string, tf long"))
    n = given.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    terms = tf.groupBy("key", "word").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    able = terms.withColumn("_at", F.row_number().over(W.partitionBy("key").orderBy(F.desc("total"), "word"))).filter(F.col("_at") <= features)
    idf = table(able.join(n, "key").select("key", "word", F.monotonically_increasing_id().alias("term"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weighed = tf.join(idf, ["key", "word"]).select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))  # features of one document
    score = weighed.withColumn("norm", norm).groupBy("term").agg(F.round(F.sum(F.col("w") / F.col("norm")), 9).alias("score")).join(idf, "term").select("key", "word", "score")
    ranked = score.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "word"))).filter(F.col("rank") <= top)
    return ranked.withColumnRenamed("key", key)


def theme_name(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, 3), "_")


def theme_id(words: Column) -> Column:
    """The same for the same set of words."""
    return F.concat(F.lit("theme_"), F.substring(F.sha2(F.array_join(F.array_sort(words), ","), 256), 1, 12))


def new_themes(outliers: DataFrame, themes: DataFrame, id_col: str = "doc_id", vector: str = "embedding", text: str = "text", threshold: float = NEW, least: int = LEAST, **clustering) -> tuple[DataFrame, DataFrame]:
    """Themes that the outliers (id, text, vector) found beside the standing ones (theme_id, centroid), and their members.

    The first has theme_id, name, words (word, score), centroid, members; the second theme_id and id.  Every outlier
    has then been looked at; whoever keeps a pool of them empties it.
    """
    size = max(3, least // 2)
    rows = table(outliers.filter(F.col(id_col).isNotNull()).select(id_col, text, vector))
    own = table(density_clusters(rows, id_col, vector, least=size, samples=max(1, size // 2), **clustering).filter("cluster is not null").select(id_col, "cluster"))
    members = table(rows.join(own.dropDuplicates([id_col]), id_col))
    centres = table(centroids(members, "cluster", vector).filter(V.norm(F.col("centroid")) > 0))
    near = assigned(centres.select("cluster", "centroid"), themes.select("theme_id", "centroid"), "theme_id", "centroid", "cluster")
    fresh = centres.join(near.filter(F.col("similarity") < threshold).select("cluster"), "cluster")
    words = tfidf_keywords(members.join(fresh.select("cluster"), "cluster"), "cluster", id_col, text)
    listed = words.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))), lambda s: F.struct(s["word"].alias("word"), s["score"].alias("score"))).alias("words"))  # TOP_WORDS
    unknown = F.array(F.struct(F.lit("unknown").alias("word"), F.lit(0.0).alias("score")))
    named = fresh.join(listed, "cluster", "left").withColumn("words", F.coalesce("words", unknown))
    plain = F.transform("words", lambda s: s["word"])
    found = named.select("cluster", theme_id(plain).alias("theme_id"), theme_name(plain).alias("name"), "words", "centroid", "members")
    last = F.row_number().over(W.partitionBy("theme_id").orderBy(F.desc("cluster")))  # of the same words the later cluster stands
    found = table(found.withColumn("_n", last).filter("_n = 1").drop("_n"))
    return found.drop("cluster"), members.join(found.select("cluster", "theme_id"), "cluster").select("theme_id", id_col)
