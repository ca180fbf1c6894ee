import random

import pytest

from foliotab.operators import reconcile


def by_hand(rows, tol):
    out = {}
    for key in {r[0] for r in rows}:
        before, run = None, 0
        for _, i, x in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            run += before is None or x is None or x - before > tol
            before = x
            out.setdefault((key, run), []).append(i)
    return sorted(tuple(sorted(v)) for v in out.values())


@pytest.mark.parametrize("width", [None, 1, 7, 60])
def test_runs_go_on_over_spans(spark, width):
    draw = random.Random(5)
    rows = [(k, i, draw.choice([None, *range(200)]) if i % 9 else 77) for i, k in enumerate(["a"] * 60 + ["b"] * 9 + [None] * 8)]
    df = spark.createDataFrame(rows, "k string, row_id long, x long")
    out = reconcile.dedupe_numeric(df, ["k"], "x", 3, width=width)
    assert out.columns == ["k", "row_id", "x", "variants"]
    runs = by_hand(rows, 3)
    got = sorted((r["variants"], r["row_id"]) for r in out.collect())
    assert len(got) == len(runs) and sum(n for n, _ in got) == len(rows)  # rows without a key too
    for n, i in got:
        assert any(len(run) == n and i in run for run in runs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # nothing is shuffled again to be joined back
