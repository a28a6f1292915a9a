"""Hashes of runs of words as ``xxhash64`` of the joined words has them, of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The 64-bit hashes (XXH64, seed 42 as in Spark) of the byte ranges lo to hi of data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,)))  # the eight bytes from each place on
    mixed = lambda x: _turned(x * _P2, 31) * _P1
    n, at = hi - lo, lo.copy()
    h = np.full(len(lo), _SEED, np.uint64) + _P5
    who = np.flatnonzero(n >= 32)
    if len(who):
        seed = np.full(len(who), _SEED, np.uint64)
        lanes = [seed + _P1 + _P2, seed + _P2, seed, seed - _P1]
        left = np.arange(len(who))
        while len(left):
            p = at[who[left]]
            for k in range(4):
                lanes[k][left] = _turned(lanes[k][left] + eight[p + 8 * k] * _P2, 31) * _P1
            at[who[left]] = p + 32
            left = left[p + 64 <= hi[who[left]]]
        whole = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            whole = (whole ^ mixed(lane)) * _P1 + _P4
        h[who] = whole
    h += n.astype(np.uint64)
    while len(who := np.flatnonzero(hi - at >= 8)):
        h[who] = _turned(h[who] ^ mixed(eight[at[who]]), 27) * _P1 + _P4
        at[who] += 8
    who = np.flatnonzero(hi - at >= 4)
    h[who] = _turned(h[who] ^ ((eight[at[who]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[who] += 4
    while len(who := np.flatnonzero(hi > at)):
        h[who] = _turned(h[who] ^ (data[at[who]].astype(np.uint64) * _P5), 11) * _P1
        at[who] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def run_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words (of all words where there are fewer) of texts, and where each text's begin, with the end; words are cut at blanks, tabs and line ends."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = ~_SPACE[data]
    cut = off[(off > 0) & (off < len(data))]
    before, after = np.append(False, inside[:-1])[: len(data)], np.append(inside[1:], False)[: len(data)]
    before[cut], after[cut - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = end - start
    # the words again, one blank between them
    begin = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    joined = np.full(begin[-1], 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    first = np.searchsorted(start, off)
    n = np.diff(first)
    runs = np.where(n > 0, np.maximum(1, n - (words - 1)), 0)
    bounds = np.concatenate([[0], np.cumsum(runs)])
    of = np.repeat(np.arange(len(n)), runs)
    head = np.arange(bounds[-1]) - bounds[of] + first[of]
    last = np.minimum(head + words, first[of + 1]) - 1
    return xxhash64(joined, begin[head], begin[last] + size[last]), bounds
