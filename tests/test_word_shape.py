"""Word shapes hold the words of one text at a time."""

from __future__ import annotations

import tracemalloc

import pandas as pd

from lodestream.functions import text as T


def test_words_of_one_text_at_a_time():
    texts = pd.Series([" ".join(f"Word{i % (k + 2)}" for i in range(4000)) for k in range(200)] + ["", None, "a A b"])
    tracemalloc.start()
    got = T._shapes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # not all 800,000 words
    assert got["n"].tolist() == [4000] * 200 + [0, 0, 3]
    assert got["share"].tolist()[:2] == [0.5, 1334 / 4000] and got["share"].tolist()[-3:] == [0.0, 0.0, 2 / 3]
