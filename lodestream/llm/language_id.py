"""Language identification by nearest centroid.

A text becomes a vector of hashed 1- to 3-byte grams of its lower-cased letters
(everything else is one space), weighted log(1 + tf) * idf and normalised.  Each
language has several centroids (spherical k-means over its training vectors); the
nearest by cosine names the language.  A text is rejected (``rejected``) when its
distance 1 - cosine exceeds what its language's training texts of that length
class show, with slack.  Where a class has fewer than ``LEAST`` of them, the limit is
pooled: over the language's neighbouring classes, or else over all languages, cosines
taken as shares of what is usual at their length (but a text that is shorter than the
class and of the same language at its own distance).  Texts of a language with few
in all are compared with centroids of its other texts, as centroids of few texts fit
those too well, and its limit is wider by how far they then lie off.

The fit is on a bounded sample of labelled rows: about ``FIT_DOCS`` documents in
all, equal shares for each language, chosen by a hash of the id; only the sample's
vectors reach the driver.  Prediction reads every whole text, in bounded slices.

Null text or a text without a letter: ``und``, score 0, rejected.  Without any
labelled row every text is ``und``.  Repeated rows and ids are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .folds import chance, fold
from .textops import LOWER, slices

DIMS, CLUSTERS, FIT_DOCS, ROUNDS = 4096, 4, 3200, 8
#: Rejected beyond SLACK times the distance that 99.5 of 100 training texts of the language and length class keep.
SLACK, TAIL, LEAST = 1.12, 0.995, 30
LENGTHS = np.array([40, 160, 640, 2560])

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows by DIMS: counts of hashed grams; a gram doesn't cross rows."""
    rows = len(off) - 1
    d = _FOLD[data].astype(np.int64)
    of = np.repeat(np.arange(rows), np.diff(off))
    out = np.bincount(of * DIMS + (d * 40503 >> 4) % DIMS, minlength=rows * DIMS)
    for n, m in ((2, 0x9E3B1), (3, 0xC2B2AE3D)):
        if len(d) >= n:
            g = d[: len(d) - n + 1] * 1
            for j in range(1, n):
                g = g * 257 + d[j : len(d) - n + 1 + j]
            ok = of[: len(g)] == of[n - 1 :]
            g = (g * m >> 7) % DIMS
            out += np.bincount(of[: len(g)][ok] * DIMS + g[ok], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def _pieces(batches):
    """Slices of few rows each, so that counts stay small."""
    for rows, data, off in slices(batches):
        for at in range(0, rows.num_rows, 256):
            to = min(at + 256, rows.num_rows)
            yield rows.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]


def _vectors(batches):
    for rows, data, off in _pieces(batches):
        v = np.log1p(gram_counts(data, off)).astype(np.float16)
        yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(np.diff(off)), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "n_bytes", "tf"])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means from a farthest-first start."""
    centre = [_unit(v.mean(axis=0))]
    while len(centre) < min(k, len(v)):
        centre.append(v[np.argmin((v @ np.array(centre).T).max(axis=1))])
    c = np.array(centre)
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(axis=1)
        c = np.array([_unit(v[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def usual_distances(far: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By length class, the median distance over all languages.

    Where texts are few, a longer text lies no farther off than a shorter one, and the
    cosine falls with the root of the length at most (classes are of fourfold length).
    """
    usual = np.full(len(LENGTHS) + 1, np.nan)
    for c in range(len(usual)):
        if (length == c).sum() >= LEAST:
            usual[c] = np.median(far[length == c])
    if np.isnan(usual).all():
        usual[np.bincount(length).argmax()] = np.median(far)
    for c in range(1, len(usual)):
        if np.isnan(usual[c]):
            usual[c] = usual[c - 1]
    for c in range(len(usual) - 2, -1, -1):
        if np.isnan(usual[c]):
            usual[c] = 1 - (1 - usual[c + 1]) / 2
    return usual


def _unseen(v: np.ndarray) -> np.ndarray:
    """Distances of a language's texts from centroids of its other texts."""
    folds = np.arange(len(v)) % min(5, len(v))
    out = np.empty(len(v))
    for f in range(folds.max() + 1):
        out[folds == f] = 1 - (v[folds == f] @ clustered(v[folds != f], CLUSTERS).T).max(axis=1)
    return out


def distance_limits(v: np.ndarray, of: np.ndarray, length: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Limits by language and length class from the sample's vectors, languages and classes; 1 where no distance is known."""
    limits, far = np.ones((len(groups), len(LENGTHS) + 1)), np.full(len(v), np.nan)
    for k, g in enumerate(groups):
        mine = v[of == k]
        if len(mine) > 1:
            far[of == k] = 1 - (mine @ g.T).max(axis=1) if len(mine) >= LEAST else _unseen(mine)
    known = ~np.isnan(far)
    if not known.any():
        return limits
    usual = usual_distances(far[known], length[known])
    share = (1 - far) / np.maximum(1 - usual[length], 1e-6)
    for k in range(len(groups)):
        mine, beyond = of == k, 0.0
        for c in range(len(usual) - 1, -1, -1):
            here = mine & (length == c)
            if here.sum() >= LEAST:  # a shorter text may lie as far off as a longer one
                limits[k, c] = beyond = max(beyond, min(1.0, np.quantile(far[here], TAIL) * SLACK))
                continue
            near = next((n for w in range(1, len(usual)) if (n := mine & (abs(length - c) <= w)).sum() >= LEAST), None)
            if near is None:
                least = np.quantile(share[known], 1 - TAIL) * _closeness(v, of, length, usual, share, k)
                pooled = 1 - (1 - usual[c]) * least
            else:  # a shorter text's distance counts as it is, a longer one's is scaled
                pooled = np.quantile(np.where(length[near] <= c, far[near], 1 - (1 - usual[c]) * share[near]), TAIL)
            limits[k, c] = max(beyond, min(1.0, pooled * SLACK))
    return limits


def _closeness(v, of, length, usual, share, k: int) -> float:
    """The share of the usual cosine that unseen texts of a language with few keep, 1 at most; for a single text, what other languages' texts keep to one of theirs."""
    mine = np.flatnonzero(of == k)
    if len(mine) > 1:
        return min(1.0, float(np.median(share[mine])))
    others = [x for j in range(of.max() + 1) if len(x := np.flatnonzero(of == j)) > 1]
    return min(1.0, float(np.median(np.concatenate([v[x[1:]] @ v[x[0]] / np.maximum(1 - usual[length[x[1:]]], 1e-6) for x in others]))))


def fit(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", n_docs: int = FIT_DOCS) -> dict:
    """Model from the rows of labelled (id, text, lang) with a text and a language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), "text").filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    model = {"langs": [], "centroids": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, np.int64), "idf": np.ones(DIMS, np.float32), "limits": np.zeros((0, len(LENGTHS) + 1))}
    if not counts:
        return model
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, n_docs / len(counts) / n)).otherwise(share)
    found = rows.filter(chance("id", "language") < share).select("lang", "text").mapInArrow(_vectors, "lang string, n_bytes long, tf binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["tf"])))
    if not found:
        return model
    tf = np.array([np.frombuffer(r["tf"], np.float16) for r in found]).astype(np.float32)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    v, langs, size = _unit(tf * idf), np.array([r["lang"] for r in found]), np.array([r["n_bytes"] for r in found])
    names = sorted(set(langs))
    groups = [clustered(v[langs == x], CLUSTERS) for x in names]
    centroids, of = np.concatenate(groups), np.repeat(np.arange(len(names)), [len(g) for g in groups])
    length = np.searchsorted(LENGTHS, size)
    limits = distance_limits(v, np.searchsorted(names, langs), length, groups)
    return model | {"langs": names, "centroids": centroids.astype(np.float32), "of": of, "idf": idf, "limits": limits}


def _no_letter(rows, data, off) -> np.ndarray:
    some = np.concatenate(([0], np.cumsum(_LETTER[LOWER[data]])))
    none = some[off[1:]] == some[off[:-1]]
    text = rows.column("text")
    for r in np.flatnonzero(none):
        none[r] = not any(c.isalpha() for c in text[int(r)].as_py() or "")
    return none


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns keep of docs (but for clashing names), lang_pred, score and rejected."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    base = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), "text")
    names = np.array([*model["langs"], "und"], dtype=object)

    def judge(batches):
        for rows, data, off in _pieces(batches):
            und = _no_letter(rows, data, off)
            if len(model["of"]):
                v = _unit(np.log1p(gram_counts(data, off), dtype=np.float32) * model["idf"])
                cosine = v @ model["centroids"].T
                best = cosine.argmax(axis=1)
                lang, score = model["of"][best], np.clip(cosine.max(axis=1), 0, 1).astype(float)
                rejected = 1 - score > model["limits"][lang, np.searchsorted(LENGTHS, np.diff(off))]
            else:
                und = np.ones(rows.num_rows, bool)
                lang, score, rejected = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows), und
            lang, score, rejected = np.where(und, len(names) - 1, lang), np.where(und, 0.0, score), rejected | und
            yield pa.RecordBatch.from_arrays([rows.column("kept_columns"), pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=["kept_columns", "lang_pred", "score", "rejected"])

    return base.mapInArrow(judge, f"kept_columns {base.schema['kept_columns'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").select(*[F.col(f"kept_columns.`{c}`") for c in keep], "lang_pred", "score", "rejected")


def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold("doc_id", 3) == 1)
    return predict(docs, fit(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])
