import numpy as np
import pytest

from foliotab.operators import vectors


@pytest.mark.parametrize("cut", [None, 0.1])
def test_nearest_equals_full_sort(cut, monkeypatch):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=(700, 4)), 1)
    y[::3] = y[0]  # many copies, so that ties decide
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    ids = rng.permutation(len(y))
    sorted_rows = []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or real(keys))
    for k in (1, 3, 8, 700):
        query, other, value = vectors._nearest(y[:60], ids[:60], y, ids, k, cut)
        sim = np.round(y[:60] @ y.T, vectors.DIGITS)
        want = []
        for i in range(60):
            best = sorted((-s, j) for s, j in zip(sim[i], ids) if cut is None or (s >= cut and j != ids[i]))[:k]
            want += [(ids[i], j, -s) for s, j in best]
        assert list(zip(query, other, value)) == want
    distinct = rng.normal(size=(700, 4))
    sorted_rows.clear()
    vectors._nearest(distinct[:60], ids[:60], distinct, ids, 8, cut)
    assert max(sorted_rows) < 60 * 100  # not all 700 a query


def test_knn_leaves_out_vectors_that_are_no_numbers(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(40, [float("nan"), 1.0, 0.0])]
    x = spark.createDataFrame(rows, "id long, v array<double>")
    got = vectors.knn(x, x, 3, block=16).collect()
    assert len(got) == 120 and all(r["query_id"] != 40 and r["vec_id"] != 40 for r in got)
