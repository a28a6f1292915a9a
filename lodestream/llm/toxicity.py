"""Toxicity by maximum-scoring segments.

Tokens (words, and beginnings of words of ``PREFIXES`` bytes for languages that
compound) score their log-odds between toxic and clean training documents under an
informative Dirichlet prior (the pooled distribution, ``PRIOR`` documents strong,
and half a document).  Tokens that lie in toxic documents more often than chance
allows (a likelihood ratio G2 of ``G2`` or more) are evidence; a word scores as
itself or else by its longest evident beginning.  All others share one small
negative score.  One linear scan
(Ruzzo-Tompa) finds all maximal segments of a text.  As scores are log-odds, the
Karlin-Altschul scale is 1 and a segment's normalised score is S - ln(K n); a
segment is a toxic passage if its expected number of chance occurrences is below
``E_VALUE``.  The document's statistic is the sum of its passages' normalised
scores, and Gumbel laws fitted to that statistic in clean and in toxic training
documents turn it into the probability of label 1.

The fit is on a bounded sample of labelled rows: about ``FIT_DOCS`` of each label,
chosen by a hash of the id.  Scoring reads every whole text, in bounded slices.

Null or empty text: no token, the statistic 0.  Without labels every score is the
prior 0.  Repeated rows are scored one by one; ids with several labels train once
per label row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .folds import chance, fold
from .storage import table
from .textops import LOWER, NOT_ALNUM, U64, Words, row_key, slices

FIT_DOCS, PRIOR, G2, K, E_VALUE = 6000, 4.0, 24.0, 0.1, 0.01
PREFIXES = (4, 5, 6, 7, 8, 9, 10)


def token_documents(batches):
    """(token, toxic, n): documents of a slice with the token."""
    for rows, data, off in slices(batches):
        w = Words(data, off, NOT_ALNUM, LOWER)
        toxic = rows.column("toxic").to_numpy().astype(np.int64)
        for at, token in [(slice(None), w.hash), *(w.prefix(k) for k in PREFIXES)]:
            row = w.row[at]
            _, one = np.unique(row_key(row, token), return_index=True)
            mine, label = token[one], toxic[row[one]]
            for y in (0, 1):
                t, n = np.unique(mine[label == y], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.full(len(t), y, np.int32)), pa.array(n)], names=["token", "toxic", "n"])


def log_odds(n1, n0, total1, total0, prior=PRIOR):
    """Log-odds under a Dirichlet prior of the pooled shares."""
    alpha = 0.5 + prior * (n1 + n0) / max(total1 + total0, 1)
    return np.log((n1 + alpha) / (total1 + prior)) - np.log((n0 + alpha) / (total0 + prior))


def likelihood_ratio(n1, n0, total1, total0):
    """G2 of n1 and n0 against the classes' shares."""
    n, p = n1 + n0, total1 / (total1 + total0)
    return 2 * (n1 * np.log(np.maximum(n1, 1) / (n * p)) + n0 * np.log(np.maximum(n0, 1) / (n * (1 - p))))


def segments(at: np.ndarray, gain: np.ndarray, rest: float):
    """All maximal-scoring segments (first hit, last hit, score): hits at words ``at`` score gain, words between them rest (< 0)."""
    stack: list[tuple] = []  # left sum, right sum, first hit, last hit, the nearest earlier one whose left sum is smaller
    total, before = 0.0, None
    for k, (word, more) in enumerate(zip(at.tolist(), gain.tolist(), strict=True)):
        if before is not None:
            total += rest * (word - before - 1)
        before = word
        left, total = total, total + more
        first, j = k, len(stack) - 1
        while j >= 0 and stack[j][0] >= left:
            j = stack[j][4]  # none in between is smaller: each link is followed once
        while j >= 0 and stack[j][1] < total:
            left, _, first, _, below = stack[j]
            del stack[j:]
            j = below
        stack.append((left, total, first, k, j))
    return [(i, j, r - l) for l, r, i, j, _ in stack]


def statistics(data, off, model):
    """By row: the sum of passages' normalised scores, and the passages (first byte, end byte, score)."""
    w = Words(data, off, NOT_ALNUM, LOWER)
    rows = len(off) - 1
    total, passages = np.zeros(rows), [[] for _ in range(rows)]
    tokens, gains = model["tokens"], model["gains"]
    if not len(tokens) or not len(w):
        return total, passages
    gain = np.full(len(w), np.nan)
    for at, token in [*(w.prefix(k) for k in PREFIXES), (np.arange(len(w)), w.hash)]:
        place = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
        known = tokens[place] == token
        gain[at[known]] = gains[place[known]]
    hit = np.flatnonzero(~np.isnan(gain))
    cut = np.searchsorted(w.row[hit], np.arange(rows + 1))
    for r in np.flatnonzero(cut[1:] > cut[:-1]):
        h = hit[cut[r] : cut[r + 1]]
        n = w.counts[r]
        for i, j, s in segments(h, gain[h], model["rest"]):
            normal = s - np.log(K * n + 1)
            if np.exp(-normal) < E_VALUE:
                total[r] += normal
                passages[r].append((int(w.starts[h[i]] - off[r]), int(w.ends[h[j]] - off[r]), float(normal)))
    return total, passages


def gumbel(y: np.ndarray) -> tuple[float, float]:
    """Location and scale by moments."""
    scale = max(0.5, float(np.std(y)) * np.sqrt(6) / np.pi)
    return float(np.mean(y)) - 0.57721566 * scale, scale


def _log_density(y, law):
    z = (y - law[0]) / law[1]
    return -z - np.exp(-np.clip(z, -50, 50)) - np.log(law[1])


def probability(y: np.ndarray, model: dict) -> np.ndarray:
    """Posterior of label 1, non-decreasing in y."""
    grid = np.linspace(0, 200, 2001)
    odds = np.log(model["share"] / (1 - model["share"])) + _log_density(grid, model["toxic"]) - _log_density(grid, model["clean"])
    p = np.maximum.accumulate(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return np.interp(np.clip(y, 0, 200), grid, p)


def fit(docs: DataFrame, labels: DataFrame, n_docs: int = FIT_DOCS) -> dict:
    """Model from docs (doc_id, text) with labels (doc_id, toxic)."""
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    model = {"tokens": np.zeros(0, U64), "gains": np.zeros(0), "rest": -1e-6, "share": 1e-9, "clean": (0.0, 1.0), "toxic": (20.0, 5.0)}
    if len(counts) < 2:
        return model
    share = F.when(F.col("toxic") == 1, min(1.0, n_docs / counts[1])).otherwise(min(1.0, n_docs / counts[0]))
    chosen = F.broadcast(labels.filter(chance("doc_id", "toxicity") < share))  # 2 * n_docs ids
    sample = table(docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t1, t0 = size.get(1, 0), size.get(0, 0)
    if not t1 or not t0:
        return model
    tokens = sample.mapInArrow(token_documents, "token long, toxic int, n long").groupBy("token").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (1, 0)])
    likely = (F.col("n1") >= 3) & (F.col("n1") * t0 > F.col("n0") * t1 * 3)
    found = np.array([(r["token"], r["n1"], r["n0"]) for r in tokens.filter(likely).collect()], dtype=np.int64).reshape(-1, 3)
    delta = log_odds(found[:, 1], found[:, 2], t1, t0)
    ok = likelihood_ratio(found[:, 1], found[:, 2], t1, t0) >= G2
    found, delta = found[ok], delta[ok]
    order = np.argsort(found[:, 0].view(U64))
    model["tokens"], model["gains"] = found[order, 0].view(U64), delta[order]
    model["rest"] = -float(min(0.05, max(1e-3, found[:, 1].sum() / t1 / 1000)))

    def measured(batches):
        for r, data, off in slices(batches):
            yield pa.RecordBatch.from_arrays([r.column("toxic"), pa.array(statistics(data, off, model)[0])], names=["toxic", "y"])

    pairs = np.array([(r["toxic"], r["y"]) for r in sample.select("toxic", "text").mapInArrow(measured, "toxic int, y double").collect()])
    y1, y0 = pairs[pairs[:, 0] == 1, 1], pairs[pairs[:, 0] == 0, 1]
    return model | {"share": counts[1] / (counts[0] + counts[1]), "clean": gumbel(y0), "toxic": gumbel(y1)}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns keep of docs (but for clashing names), score, predicted and passages (first byte, end byte, normalised score)."""
    keep = [c for c in keep if c not in ("score", "predicted", "passages")]
    base = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text")
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def judge(batches):
        for rows, data, off in slices(batches):
            y, passages = statistics(data, off, model)
            p = probability(y, model)
            spelled = [[{"begin": a, "end": b, "score": s} for a, b, s in x] for x in passages]
            yield pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spelled, spans)], names=["kept_columns", "score", "predicted", "passages"])

    return base.mapInArrow(judge, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, score double, predicted int, passages array<struct<begin:long,end:long,score:double>>").select(*[F.col(f"kept_columns.`{c}`") for c in keep], "score", "predicted", "passages")


def op2_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    return score(docs, fit(docs.filter(~F.col("held_out")), labels), ["doc_id", "held_out"])
