"""Keywords of single documents by TextRank.

Words that may be keywords are nodes, two of them are linked as often as they stand
fewer than ``window`` words apart, and a fixed number of damped power rounds ranks them.  The graphs of
all documents of a slice of an Arrow batch lie side by side in the same arrays, so a round is one
weighted count whatever the number of documents.  Nothing is shuffled.  Keywords are
phrases: words that follow one another without a mark or an excluded word between,
``longest`` at a time, ranked by the sum of their words' ranks.

A null text and one without words have no rows.  Repeated rows give their keywords each.
Ties fall to the smaller phrase.  Whole texts are ranked, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Function words of English, as usual; a parameter.
STOP = frozenset("a an and are as at be by for from has have he in is it its of on or that the this to was were will with".split())
WINDOW, DAMPING, ROUNDS, LONGEST, LIMIT, SHORTEST = 4, 0.85, 20, 3, 10, 3
#: Tokens of a slice.
TOKENS = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased words (letters and digits) and the runs of marks between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}]+)"), F.lit(1))


def token_slices(batches: Iterator[pa.RecordBatch], column: str = "tokens", size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, the row of each token, its code, the words of the codes) of about ``size`` tokens each (TOKENS, if not given)."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        if lists.null_count:
            lists = lists.fill_null(pa.scalar([], lists.type))
        off = lists.offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + (size or TOKENS), side="right")) - 1)
            coded = lists.values.slice(off[at], off[to] - off[at]).dictionary_encode()
            yield batch.slice(at, to - at), np.repeat(np.arange(to - at), np.diff(off[at : to + 1])), coded.indices.to_numpy().astype(np.int64), coded.dictionary
            at = to


def ranked(row: np.ndarray, word: np.ndarray, place: np.ndarray, window: int, damping: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (row, word), the rank of each, and the node of each token; place is a token's number among its text's words."""
    top = int(word.max(initial=0)) + 1
    nodes, of = np.unique(row * top + word, return_inverse=True)
    ends = []
    for gap in range(1, window):  # candidates less than window words apart are at most that many candidates apart
        near = (row[gap:] == row[:-gap]) & (place[gap:] - place[:-gap] < window) & (of[gap:] != of[:-gap])
        ends.append(np.stack([of[:-gap][near], of[gap:][near]]))
    a, b = np.concatenate([*ends, np.zeros((2, 0), np.int64)], axis=1)
    pairs, weight = np.unique(np.concatenate([a * len(nodes) + b, b * len(nodes) + a]), return_counts=True)
    source, target = pairs // max(1, len(nodes)), pairs % max(1, len(nodes))
    strength = np.bincount(source, weight, minlength=len(nodes))
    node_row = nodes // top
    size = np.bincount(node_row, minlength=int(node_row.max(initial=0)) + 1)[node_row].astype(float)
    share = weight / strength[source]
    rank = 1 / size
    for _ in range(rounds):
        rank = (1 - damping) / size + damping * np.bincount(target, share * rank[source], minlength=len(nodes))
    return node_row, nodes % top, rank, of


def textrank(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT, window: int = WINDOW, damping: float = DAMPING, rounds: int = ROUNDS, longest: int = LONGEST, shortest: int = SHORTEST, stop: frozenset[str] = STOP) -> DataFrame:
    """id, rank, keyword, score, count: the ``limit`` best phrases of each document."""
    names = [id_col, "rank", "keyword", "score", "count"]

    def run(batches):
        for rows, row, code, spelled in token_slices(batches):
            word = pc.match_substring_regex(spelled, r"^[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
            able = word & (pc.utf8_length(spelled).to_numpy() >= shortest) & ~pc.is_in(spelled, value_set=pa.array(sorted(stop), spelled.type)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(able[code]) if len(code) else np.zeros(0, np.int64)
            if not len(at):
                continue
            place = np.cumsum(word[code])[at]  # rows differ where places might meet
            _, _, rank, of = ranked(row[at], code[at], place, window, damping, rounds)
            start = np.ones(len(at), bool)
            start[1:] = (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])
            run_of = np.cumsum(start) - 1
            within = np.arange(len(at)) - np.flatnonzero(start)[run_of]
            head = np.flatnonzero(within % longest == 0)
            size = np.diff(np.append(head, len(at)))
            phrase = np.full((len(head), longest + 1), -1, np.int64)
            phrase[:, 0] = row[at][head]
            total = np.zeros(len(head))
            for k in range(longest):
                has = size > k
                phrase[has, k + 1] = code[at][head[has] + k]
                total[has] += rank[of[head[has] + k]]
            kinds, first, count = np.unique(phrase, axis=0, return_index=True, return_counts=True)
            words = spelled.to_pylist()
            text_of = [" ".join(words[c] for c in p[1:] if c >= 0) for p in kinds.tolist()]
            score = np.round(total[first], 9)
            order = sorted(range(len(kinds)), key=lambda i: (kinds[i, 0], -score[i], text_of[i]))
            of_row = kinds[order, 0]
            place_in = np.arange(len(order)) - np.searchsorted(of_row, of_row, side="left") + 1
            kept = [(i, p) for i, p in zip(order, place_in.tolist(), strict=True) if p <= limit]
            take = [i for i, _ in kept]
            yield pa.RecordBatch.from_arrays([rows.column(id_col).take(pa.array(kinds[take, 0])), pa.array([p for _, p in kept], pa.int32()), pa.array([text_of[i] for i in take]), pa.array(score[take]), pa.array(count[take].astype(np.int64))], names=names)

    return docs.select(id_col, tokens(F.col(text)).alias("tokens")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, rank int, keyword string, score double, count long")
