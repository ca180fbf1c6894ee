"""Hard negatives against all pairs, and the bounds against the scores they bound."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliotab.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, key int"


def brute(rows, positives, negatives, low=80, high=100):
    rows = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    out = []
    for i, label, q in ints:
        if i % 10:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, p)), j, other == label) for j, other, p in ints if j != i)
        found = [(max(-(1 << 63), min((1 << 63) - 1, -s)), j, same) for s, j, same in found]
        found.sort(key=lambda t: (-t[0], t[1]))
        for ps, j, _ in [t for t in found if t[2]][:positives]:
            fits = [t for t in found if not t[2] and low * ps <= 100 * t[0] <= high * ps][:negatives]
            out += [(i, j, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def answer(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], SCHEMA).repartition(3)
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(kind, n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "random":
        v = rng.normal(size=(n, d))
    elif kind == "clustered":
        v = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + 0.05 * rng.normal(size=(n, d))
    elif kind == "lengths":
        v = rng.normal(size=(n, d)) * 10.0 ** rng.integers(-2, 3, n)[:, None]
    elif kind == "ties":
        v = rng.integers(-1, 2, (n, 3)).astype(float)
    else:
        v = np.ones((n, d)) * 0.3
    return [(i, x.astype(np.float32).tolist(), int(c)) for i, (x, c) in enumerate(zip(v, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths", "ties", "equal"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 3_000])
def test_all_pairs(spark, kind, block_bytes, monkeypatch):
    monkeypatch.setattr(H, "TILE_ROWS", 37)
    monkeypatch.setattr(H, "TILE_ANCHORS", 7)
    rows = vectors(kind)
    assert answer(spark, rows, block_bytes=block_bytes) == brute(rows, 5, 5)


def test_other_settings(spark):
    rows = vectors("clustered", 200)
    assert answer(spark, rows, positives=2, negatives=9, low=30, high=90, references=3, sample_rows=5) == brute(rows, 2, 9, 30, 90)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (10, None, 1), (20, [], 1), (30, [0.0, 0.0], 1), (31, [0.0], 1), (32, [0.0, 0.0], 2), (40, [1.0, nan], 1), (50, [1.0, None], 1), (60, [1.0, -inf], 1),
        (None, [1.0, 1.0], 1), (70, [1.0, 1.0], None), (80, [1.0, 1.0, 1.0], 1), (80, [1.0, 1.0, 1.0], 1), (81, [1.0, 1.0], 1), (82, [1.0, 0.9], 2), (82, [1.0, 0.9], 2),
        (83, [1.0, 0.8], 3), (80, [0.5, 1.0], 2), (90, [3e30, 1.0], 1), (91, [3e30, 2.0], 1), (92, [2.9e30, 2.0], 2), (100, [-1.0], 1),
    ]
    assert answer(spark, odd) == brute([(i, (v + [0.0] * (3 - len(v))) if v is not None else v, label) for i, v, label in odd], 5, 5)
    assert answer(spark, []) == []
    assert answer(spark, [(10, None, 1)]) == []
    assert answer(spark, [(10, [], 1), (20, [], 1), (1, [], 2)]) == [(10, 20, 1, 1, 0, 0), (20, 10, 1, 1, 0, 0)]


def test_bounds_hold():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    q = np.floor(256 * rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-1, 4, 400)[:, None])
    q[:20] = q[20:40] * 3  # equal directions: angles of 0
    q[40:60] = -q[20:40]
    q[60] = 0
    directions = H.spread_directions(q[:100], 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["a"] * 400), pa.array([True] * 400), pa.array(range(400)), H._lists(q / 256)], names=["id", "label", "asked", "key", "v"])
    side = H.Side(pa.Table.from_batches(list(H._measured(directions, 6, 256)(iter([batch])))))
    low, high = H.score_bounds(side, np.arange(400), side, np.arange(400))
    exact = q @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low < 2 * np.outer(side.norm, side.norm) + 3).mean() > 0.5
