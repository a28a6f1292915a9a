"""The best rows of a query are held, and nothing else."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestream.operators import vectors as V


def _batches(ids, x, size):
    for at in range(0, len(ids), size):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + size]), pa.array(x[at : at + size].tolist(), pa.list_(pa.float64()))], names=["vec_id", "embedding"])


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (5000, 3)).astype(float)  # many equal directions
    ids, names = rng.permutation(5000).tolist(), [7, 11, 4999]
    q = V.unit(x[[ids.index(n) for n in names]])
    c = np.round(q @ V.unit(x).T, 9)
    for limit, least in ((1, 0.5), (20, 0.05), (4000, -1.0)):
        got = V._nearest(_batches(ids, x, 700), names, q, limit, least, "embedding", "vec_id")
        for i, n in enumerate(names):
            assert got[i] == sorted((-s, k) for s, k in zip(c[i], ids, strict=True) if s >= least and k != n)[:limit]


def test_nearest_holds_a_bounded_number():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 8))
    batches = list(_batches(list(range(8000)), x, 8000))
    q = V.unit(x[:300])
    tracemalloc.start()
    V._nearest(batches, list(range(300)), q, 20, -1.0, "embedding", "vec_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # not all 2.4 million pairs


def test_rows_without_id_or_of_the_query_leave_room_for_others():
    """As in SQL, where e.id <> q.id is unknown for a null: they tie with others and may be many."""
    x = np.tile([[1.0, 0.0], [1.0, 0.0], [1.0, 0.1]], (10, 1))
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(30)]
    got = V._nearest(_batches(ids, x, 16), [7, 8], np.array([[1.0, 0.0]] * 2), 3, 0.5, "embedding", "vec_id")
    assert [k for _, k in got[0]] == [2, 5, 8] and [k for _, k in got[1]] == [7, 7, 7]
