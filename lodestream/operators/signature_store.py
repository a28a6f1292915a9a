"""Near duplicates across batches: a store of signatures that every new batch is looked up in and joins.

The rule is that of documents coming one after another: a document is an exact duplicate if an
earlier one that was kept has its fingerprint, a near duplicate if its estimated similarity with an earlier document
that was kept (and shares a band with it) is ``THRESHOLD`` or more, and else it is kept.  So batches give what one run over
all their documents gives.

Signatures as similar as the threshold differ in so few places that they agree in a whole part, if there is one part
more than such places.  Parts are what documents meet by (at 0.85 twenty, of six or seven places; where there would
be more parts than bands, the bands), so documents that only share a band hardly meet.  Most have no part in common
with another and are decided by that; only of the others signatures are looked up.

Inside a batch the rule is applied in rounds.  Equal signatures are one node, its earliest document.  A
node that comes first in each of its bands is kept and what is similar to it goes, which
empties large groups of copies at once (``LEADERS`` rounds); what is left is compared in blocks of bounded size, of
which only similar pairs leave, and those decide each other from the earliest on.

The store is a folder: ``documents`` (what became of each) and ``kept`` (signatures, whose parts are hashed when
they are looked up), each with a folder for every batch (``epoch``).  A batch that is run again replaces its own folders and sees earlier ones
only, so a replay changes nothing.  Documents older than ``since`` are looked up no more, and ``expire``
deletes the folders that have nothing younger.

A text without words has no signature and is compared by fingerprint only.  A null id is an id like others in
the order (the last).  Repeated ids are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..sources.scratch import discard, table
from .vectors import PERMUTATIONS, bands_of, minhashed, parts_of

# Fixed values
SHINGLE, SHORT, THRESHOLD = 3, 6, 0.85
LEADERS, BLOCK = 3, 256
#: What the signature of a text without words consists of; no other has it.
NO_WORDS = -1
_SCHEMAS = {
    "documents": "doc string, fingerprint string, canonical string, kind string, similarity double, at timestamp, place long, epoch long",
    "kept": "node string, doc string, signature array<long>, at timestamp, epoch long",
}


@dataclass(frozen=True)
class SignatureStore:
    path: str

    def read(self, spark: SparkSession, name: str, before: int) -> DataFrame:
        """A table's rows of the batches before one."""
        try:
            return spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}").filter(F.col("epoch") < before)
        except AnalysisException:  # no batch yet
            return spark.createDataFrame([], _SCHEMAS[name])

    def write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.drop("epoch").write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")


def shingles(text: Column) -> Column:
    """Hashes of runs of three words; of texts under six words the single words too."""

    def hashes(h: Column) -> Column:
        runs = F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]))).otherwise(F.array().cast("array<long>"))
        single = F.when(F.size(h) < SHORT, h).otherwise(F.array().cast("array<long>"))
        return F.array_distinct(F.concat(runs, single))

    words = T.words(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""))
    # a variable of a lambda, so that the words are cut and hashed once and not once for every run
    return F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), hashes)[0]


def alike(a: str, b: str) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))


def similar(nodes: DataFrame, bands: DataFrame, kept: DataFrame, kept_bands: DataFrame, threshold: float) -> DataFrame:
    """node, rank, match (a document), earlier (its rank, null of a stored one), similarity: the kept nodes as like a node (node, rank, signature) as threshold, of those that share a band."""
    met = bands.select("band", "node").join(kept_bands.select("band", F.col("node").alias("by")), "band").select("node", "by").distinct()
    sides = met.join(nodes.select("node", "rank", "signature"), "node").join(kept.select(F.col("node").alias("by"), F.col("doc").alias("match"), F.col("signature").alias("other"), F.col("rank").alias("earlier")), "by")
    return sides.withColumn("similarity", alike("signature", "other")).filter(F.col("similarity") >= threshold).select("node", "rank", "match", "earlier", "similarity")


def similar_pairs(nodes: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """a, b: nodes that share a band and are similar, a the earlier; each band in blocks."""
    sizes = bands.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = bands.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    # block i meets block j >= i in the group (i, j)
    groups = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
    rows = placed.select("band", "node", "block", F.explode(groups).alias("g")).select("band", "node", "block", "g.i", "g.j").join(nodes.select("node", "rank", "signature"), "node")

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        m, names, block = np.array(frame["signature"].tolist()), frame["node"].tolist(), frame["block"].to_numpy()
        whole = frame["i"].iloc[0] == frame["j"].iloc[0]
        out = []
        for k in range(1, len(names)):
            near = np.flatnonzero(((m[:k] == m[k]).mean(axis=1) >= threshold) & (whole | (block[:k] != block[k])))
            out += [(names[x], names[k]) for x in near.tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="str")

    return rows.groupBy("band", "i", "j").applyInPandas(pairs, "a string, b string").distinct()


def _first_come(nodes: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """node of those that are kept of nodes (node, doc, rank, signature), by the rule of one after another."""
    out, left = [], nodes.select("node", "doc", "rank", "signature")
    for _ in range(LEADERS):
        if not left.limit(1).count():
            break
        mine = bands.join(left.select("node", "rank"), "node")
        first = mine.groupBy("band").agg(F.min("rank").alias("first"))
        leads = table(mine.join(first, "band").groupBy("node").agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("leads")).filter("leads = 1").select("node"))
        out.append(leads)
        chosen = left.join(leads, "node")
        rest = left.join(leads, "node", "left_anti")
        gone = similar(rest, bands.join(rest.select("node"), "node", "left_semi"), chosen, bands.join(leads, "node", "left_semi"), threshold).filter("earlier < rank")
        left = table(rest.join(gone.select("node").distinct(), "node", "left_anti"))
    links = table(similar_pairs(left, bands.join(left.select("node"), "node", "left_semi"), threshold)) if out else None
    undecided = table(left.select("node"))
    while links is not None and undecided.limit(1).count():
        # nobody before it that is still open, nobody before it that was kept (those went with their links)
        free = table(undecided.join(links.select(F.col("b").alias("node")), "node", "left_anti"))
        out.append(free)
        gone = table(links.join(free.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        old = links, undecided
        undecided = table(undecided.join(free, "node", "left_anti").join(gone, "node", "left_anti"))
        links = table(links.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").join(free.select(F.col("node").alias("a")), "a", "left_anti"))
        discard(*old)
    kept = nodes.limit(0).select("node")
    for x in out:
        kept = kept.union(x)
    return table(kept)


def add_batch(spark: SparkSession, store: SignatureStore, docs: DataFrame, epoch: int, at: str, text: str = "text", id_col: str = "doc_id", fingerprint: Column | None = None, threshold: float = THRESHOLD, since=None) -> DataFrame:
    """id, duplicate (exact, near or null), canonical, similarity of a batch, which the store has afterwards.

    Documents come in the order of at (a time), then id.  fingerprint: an expression over docs, the text's SHA-256 if not given.
    """
    print_of = F.sha2(F.coalesce(text, F.lit("")), 256) if fingerprint is None else fingerprint
    key = F.struct(F.col(id_col).cast("string").alias("doc"), F.col(at).cast("timestamp").alias("at"), print_of.alias("fingerprint"), F.monotonically_increasing_id().alias("place"))
    # the only reading of the texts: from here on a document is its fingerprint and its signature
    read = minhashed(docs.select(key.alias("key"), shingles(F.coalesce(text, F.lit(""))).alias("h")), "key")
    own = F.when(F.col("signature")[0] != NO_WORDS, F.col("signature"))
    base = table(read.select("key.*", own.alias("signature")).withColumn("same", F.when(F.col("signature").isNotNull(), F.struct(F.xxhash64("signature").alias("x"), F.xxhash64(F.lit(1), "signature").alias("y")))))
    # a text whose order is that of time, id (shorter ones first) and place
    order = F.format_string("%d%020d%d%06d%s %020d", F.col("at").isNull().cast("int"), F.coalesce(F.unix_micros("at"), F.lit(0)) + F.lit(1 << 62), F.col("doc").isNull().cast("int"), F.coalesce(F.length("doc"), F.lit(0)), F.coalesce("doc", F.lit("")), F.col("place"))
    young = (lambda df: df) if since is None else (lambda df: df.filter(F.col("at") >= F.lit(since)))
    known = young(store.read(spark, "documents", epoch)).filter("kind = 'kept'").groupBy("fingerprint").agg(F.min_by("canonical", F.struct("at", "doc")).alias("canonical"))
    firsts = base.withColumn("rank", order).groupBy("fingerprint").agg(F.min(F.struct("rank", "doc", "at", "place", "same")).alias("s")).select("fingerprint", "s.*")
    news = table(firsts.join(known, "fingerprint", "left_anti").withColumn("node", F.concat_ws("/", F.lit(epoch), F.col("place"))))
    # equal signatures are one node, without the signature itself: 128 bits of it tell it from others
    nodes = table(news.filter("same is not null").groupBy("same").agg(F.min(F.struct("rank", "node", "doc", "at", "place")).alias("s"), F.count("*").alias("n")).select("same", "n", "s.*"))
    stored, parts = young(store.read(spark, "kept", epoch)), parts_of(threshold)
    keyed = table(base.filter("same is not null").select("place", bands_of(parts=parts).alias("bands")).join(nodes.select("place", "node"), "place").select("node", "bands"))
    pool = keyed.select(F.explode("bands").alias("band"), "node", F.lit(True).alias("own")).union(stored.select(F.explode(bands_of(parts=parts)).alias("band"), "node", F.lit(False)))
    busy = pool.groupBy("band").agg(F.count("*").alias("n"), F.max("own").alias("news")).filter("n > 1 and news").select("band")
    shared = table(pool.join(busy, "band").select("band", "node", "own"))
    bands, stored_bands = shared.filter("own"), shared.filter("not own")
    crowd = table(nodes.join(bands.select("node").distinct(), "node", "left_semi").select("node", "doc", "rank", "place"))
    signature = base.select("place", "signature")
    signed = table(crowd.join(signature, "place").select("node", "doc", "rank", "signature"))
    met = table(stored.join(stored_bands.select("node").distinct(), "node", "left_semi").select("node", "doc", F.lit(None).cast("string").alias("rank"), "signature"))
    old = table(similar(signed, bands, met, stored_bands, threshold))
    open_ = signed.join(old.select("node").distinct(), "node", "left_anti")
    kept = _first_come(open_, bands.join(open_.select("node"), "node", "left_semi"), threshold)
    gone = table(crowd.join(kept, "node", "left_anti").select("node"))
    fresh = nodes.join(gone, "node", "left_anti")
    among = similar(signed.join(gone, "node", "left_semi"), bands.join(gone, "node", "left_semi"), signed.join(kept, "node", "left_semi"), bands.join(kept, "node", "left_semi"), threshold)
    # what has the signature of a kept node is like that alone, what has that of another is like all that this is like and come earlier
    heads = table(nodes.join(gone.withColumn("lost", F.lit(True)), "node", "left").filter("lost or n > 1").select("same", F.col("node").alias("head"), F.col("doc").alias("head_doc"), F.coalesce("lost", F.lit(False)).alias("lost")))
    placed = news.join(heads, "same").select("node", "rank", "head", "head_doc", "lost")
    twins = placed.filter("not lost and node <> head").select("node", F.col("head_doc").alias("canonical"), F.lit(1.0).alias("similarity"))
    found = placed.filter("lost").select("node", "rank", "head").join(old.union(among).select(F.col("node").alias("head"), "match", "earlier", "similarity"), "head").filter("earlier is null or earlier < rank")
    best = W.partitionBy("node").orderBy(F.desc("similarity"), F.length("match"), "match")
    matched = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("node", F.col("match").alias("canonical"), "similarity")
    first = news.join(twins.union(matched), "node", "left").withColumn("kind", F.when(F.col("canonical").isNull(), "kept").otherwise("near")).withColumn("canonical", F.coalesce("canonical", "doc"))
    first = table(first.select("doc", "fingerprint", "canonical", "kind", "similarity", "at", "place"))
    again = base.select("doc", "fingerprint", "at", "place").join(known.withColumnRenamed("canonical", "_known"), "fingerprint", "left").join(first.select("fingerprint", F.col("canonical").alias("_own"), F.col("kind").alias("_kind"), F.col("similarity").alias("_near"), F.col("place").alias("_first")), "fingerprint", "left").filter("_known is not null or place <> _first")
    as_near = F.col("_known").isNull() & (F.col("_kind") == "near")  # only what was kept has copies, others are as near as their first
    exact = again.select("doc", "fingerprint", F.coalesce("_known", "_own").alias("canonical"), F.when(as_near, "near").otherwise("exact").alias("kind"), F.when(as_near, F.col("_near")).otherwise(1.0).alias("similarity"), "at", "place")
    out = table(first.unionByName(exact))
    store.write(signature.join(fresh.select("place", "node", "doc", "at"), "place").select("node", "doc", "signature", "at"), "kept", epoch)
    store.write(out, "documents", epoch)  # the last: a batch without it is run again
    discard(base, news, nodes, keyed, shared, crowd, signed, met, old, gone, heads, first)
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.when(F.col("kind") != "kept", F.col("kind")).alias("duplicate"), F.col("canonical").cast(docs.schema[id_col].dataType).alias("canonical"), "similarity")


def expire(spark: SparkSession, store: SignatureStore, since) -> list[int]:
    """Deletes the batches without a document as young as since; their numbers."""
    try:
        ages = spark.read.schema(_SCHEMAS["documents"]).parquet(f"{store.path}/documents").groupBy("epoch").agg(F.max("at").alias("last"))
    except AnalysisException:
        return []
    gone = sorted(r[0] for r in ages.filter(F.col("last") < F.lit(since)).select("epoch").collect())  # a row for each batch
    for name in _SCHEMAS:
        for epoch in gone:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/{name}/epoch={epoch}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return gone
