"""Hard negatives by angular triangle filtering: stored angles to reference directions bound every score before it is taken."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliotab.session import cut_lineage

SCALE = 256
REFERENCES = 32
#: Rows (of smallest hash) that the reference directions are chosen from; they set the speed only, never the result.
SAMPLE_ROWS = 2_048
#: Bytes of vectors that a task holds of either side at once, and rows below which a block is not worth a task.
BLOCK_BYTES = 8 << 20
LEAST_ROWS = 1_024
TILE_ANCHORS, TILE_ROWS = 64, 4_096
#: Bound on the rounding of a stored angle and of a difference or sum of two, in radians.
SLACK = 1e-5
#: Integers up to here are exact in double precision.
EXACT = 2.0**52
LONGEST = (1 << 63) - 1

ROW = "id long, label string, asked boolean, key long, q array<double>, norm double, angles array<float>"


def whole(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def spread_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each the one farthest in angle from those before."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _measured(directions: np.ndarray, width: int, scale: int):
    """Integer vectors, their norms and their angles to the directions (a right angle where the norm is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                q = np.floor(scale * _padded(part.column(4), width))
                norm = np.linalg.norm(q, axis=1)
                with np.errstate(all="ignore"):
                    cos = np.where(norm[:, None] > 0, (q @ directions.T) / norm[:, None], 0.0)
                angles = np.arccos(np.clip(np.nan_to_num(cos), -1, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], _lists(q), pa.array(norm), _lists(angles)], names=["id", "label", "asked", "key", "q", "norm", "angles"])

    return run


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


class Side:
    """One block of rows as arrays."""

    def __init__(self, table: pa.Table):
        def matrix(name: str) -> np.ndarray:
            column = table[name].combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

        self.id = table["id"].to_numpy()
        self.key = table["key"].to_numpy()
        self.label = table["label"].to_numpy(zero_copy_only=False).astype(str)
        self.norm = table["norm"].to_numpy()
        self.q, self.angles = matrix("q"), matrix("angles")


def score_bounds(a: Side, rows: slice, b: Side, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each pair can have.

    The angle between two vectors is at least the difference, and at most the sum (or the sum's complement to a full turn),
    of their angles to any direction. Angles are widened by ``SLACK``, products by a share and by one.
    """
    ta, tb = a.angles[rows], b.angles[cols]
    near = np.zeros((len(ta), len(tb)), np.float32)
    far = np.full((len(ta), len(tb)), np.pi, np.float32)
    for r in range(ta.shape[1]):
        x, y = ta[:, r, None], tb[None, :, r]
        np.maximum(near, np.abs(x - y), out=near)
        total = x + y
        np.minimum(far, np.minimum(total, np.float32(2 * np.pi) - total), out=far)
    with np.errstate(all="ignore"):
        size = a.norm[rows][:, None] * b.norm[cols][None, :]
        low = np.cos(np.minimum(far.astype(np.float64) + SLACK, np.pi)) * size
        high = np.cos(np.maximum(near.astype(np.float64) - SLACK, 0)) * size
        low, high = low - np.abs(low) * 1e-9 - 1, high + np.abs(high) * 1e-9 + 1
    open_ = ~np.isfinite(size)
    low[open_], high[open_] = -np.inf, np.inf
    return np.minimum(low, 2.0**63), np.maximum(high, -(2.0**63))  # scores end there


def scores(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (i, j); beyond 64 bits they are the largest or smallest of 64 bits."""
    out = np.empty(len(i), np.int64)
    plain = float(a.norm.max(initial=0)) * float(b.norm.max(initial=0)) < EXACT
    for at in range(0, len(i), 16_384):
        x, y = a.q[i[at : at + 16_384]], b.q[j[at : at + 16_384]]
        if plain:
            out[at : at + 16_384] = np.einsum("pd,pd->p", x, y)
        else:
            exact = [sum(int(u) * int(v) for u, v in zip(p, r)) for p, r in zip(x.tolist(), y.tolist())]
            out[at : at + 16_384] = [max(-LONGEST - 1, min(LONGEST, s)) for s in exact]
    return out


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group by score, largest first, ties to the smaller id."""
    order = np.lexsort((ids, -score.astype(np.float64), group)) if np.abs(score).max(initial=0) < EXACT else np.array(sorted(range(len(group)), key=lambda p: (group[p], -int(score[p]), ids[p])), np.int64)
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest value, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Top:
    """The first ``k`` (score, row) of each group so far, and the score that a new one must reach."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, -np.inf)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.append(self.group, group), np.append(self.score, score), np.append(self.id, ids)
        keep = best(group, score, ids, self.k)
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        ends = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True)) if len(keep) else keep
        full = np.bincount(self.group, minlength=len(self.least))[self.group[ends]] == self.k
        self.least[self.group[ends[full]]] = self.score[ends[full]]


def nearest_alike(a: Side, b: Side, k: int) -> Iterator[tuple[np.ndarray, Top]]:
    """Per tile of anchors: their first ``k`` other rows of the same label."""
    for label in np.unique(a.label):
        mine, others = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        for at in range(0, len(mine), TILE_ANCHORS):
            rows = mine[at : at + TILE_ANCHORS]
            top = Top(len(rows), k)
            for to in range(0, len(others), TILE_ROWS):
                cols = others[to : to + TILE_ROWS]
                low, high = score_bounds(a, rows, b, cols)
                self_ = a.id[rows][:, None] == b.id[cols][None, :]
                low[self_] = -np.inf
                need = np.maximum(top.least, kth_largest(low, k))
                i, j = np.nonzero((high >= need[:, None]) & ~self_)
                top.add(i, scores(a, rows[i], b, cols[j]), b.id[cols[j]])
            yield rows, top


def nearest_in_windows(a: Side, floors: np.ndarray, tops: np.ndarray, b: Side, k: int) -> Iterator[tuple[np.ndarray, Top]]:
    """Per tile of anchors: the first ``k`` rows of other labels in each of an anchor's windows (group: anchor x windows + window).

    A pair is scored if its interval meets a window, and reaches what the window's k-th row has for certain.
    """
    width = floors.shape[1]
    for at in range(0, len(a.id), TILE_ANCHORS):
        rows = np.arange(at, min(at + TILE_ANCHORS, len(a.id)))
        top = Top(len(rows) * width, k)
        for to in range(0, len(b.id), TILE_ROWS):
            cols = np.arange(to, min(to + TILE_ROWS, len(b.id)))
            low, high = score_bounds(a, rows, b, cols)
            apart = (a.label[rows][:, None] != b.label[cols][None, :]) & (a.id[rows][:, None] != b.id[cols][None, :])
            meets = np.zeros(apart.shape, bool)
            for w in range(width):
                under, over = floors[rows, w][:, None].astype(np.float64), tops[rows, w][:, None].astype(np.float64)
                sure = np.where(apart & (low >= under) & (high <= over), low, -np.inf)
                need = np.maximum(under[:, 0], np.maximum(top.least[w::width], kth_largest(sure, k)))
                meets |= (high >= need[:, None]) & (low <= over)
            i, j = np.nonzero(meets & apart)
            found = scores(a, rows[i], b, cols[j])
            for w in range(width):
                fits = (found >= floors[rows[i], w]) & (found <= tops[rows[i], w])
                top.add(i[fits] * width + w, found[fits], b.id[cols[j[fits]]])
        yield rows, top


def _alike(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(4)]
        if anchors.num_rows and rows.num_rows:
            a, b = Side(anchors), Side(rows)
            for tile, top in nearest_alike(a, b, k):
                new = (a.id[tile[top.group]], a.key[tile[top.group]], top.id, top.score)
                out = [np.append(x, y) for x, y in zip(out, new)]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "key", "positive_id", "positive_score"])

    return run


def _between(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(6)]
        if anchors.num_rows and rows.num_rows:
            a, b = Side(anchors), Side(rows)
            found = anchors["positives"].to_pylist()
            width = max(map(len, found))
            # an empty window where an anchor has fewer positives
            floors, tops = np.ones((len(found), width), np.int64), np.zeros((len(found), width), np.int64)
            ids = np.zeros((len(found), width), np.int64)
            for n, positives in enumerate(found):
                for w, p in enumerate(positives):
                    s = p["positive_score"]
                    floors[n, w] = max(-LONGEST - 1, min(LONGEST, -(-low * s // 100)))
                    tops[n, w], ids[n, w] = max(-LONGEST - 1, min(LONGEST, high * s // 100)), p["positive_id"]
            scored = np.array([[p["positive_score"] for p in x] + [0] * (width - len(x)) for x in found], np.int64)
            for tile, top in nearest_in_windows(a, floors, tops, b, k):
                n, w = tile[top.group // width], top.group % width
                new = (a.id[n], a.key[n], ids[n, w], scored[n, w], top.id, top.score)
                out = [np.append(x, y) for x, y in zip(out, new)]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "key", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = SCALE, references: int = REFERENCES, sample_rows: int = SAMPLE_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor, higher first, ties to the
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels with ``low`` % <= negative score <= ``high`` % of the positive score are returned.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows (id, label, vector)
    are one; rows that share only their id are rows of their own, but never partners of each other. Shorter vectors count
    as padded with zeros. Scores beyond 64 bits are the nearest number of 64 bits. Other columns are not read.

    Both sides are hashed into blocks of at most about ``block_bytes`` of vectors and each block of anchors meets each block
    of rows, so a task's memory is fixed however many rows share a label or a direction; a task sends at most ``negatives``
    rows for an anchor and positive. Inside, pairs are scored only where the interval of their scores, from the stored
    angles and norms, meets what is still wanted; so the result is exact.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("v")))
    rows = rows.select("id", "label", "asked", F.xxhash64("id", "label", "v").alias("key"), "v")
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    sample = [r["v"] for r in rows.orderBy("key").limit(sample_rows).select("v").collect()]
    if not sample:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0])
    points = np.zeros((len(sample), width))
    for n, x in enumerate(sample):
        points[n, : len(x)] = x
    directions = spread_directions(np.floor(scale * points), references)
    table = cut_lineage(rows.distinct().mapInArrow(_measured(directions, width, scale), ROW))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asked").alias("anchors")).first()
    most = max(1, block_bytes // (8 * width))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(size["rows"] / most), min(2 * cores, math.ceil(size["rows"] / LEAST_ROWS)))
    groups = max(1, math.ceil(size["anchors"] / most))
    anchors = table.where("asked").withColumn("group", F.pmod("key", F.lit(groups)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = table.withColumn("block", F.pmod("key", F.lit(blocks))).withColumn("group", every(groups))
    at = ["group", "block"]
    right = dealt.select(*at, "id", "label", "key", "q", "norm", "angles").groupBy(*at)

    left = anchors.withColumn("block", every(blocks)).select(*at, "id", "label", "key", "q", "norm", "angles").groupBy(*at)
    near = left.cogroup(right).applyInArrow(_alike(positives), "anchor_id long, key long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    near = near.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("positives"))  # ``positives`` at most
    windows = cut_lineage(anchors.join(near.withColumnRenamed("anchor_id", "id"), ["id", "key"]))

    left = windows.withColumn("block", every(blocks)).select(*at, "id", "label", "key", "q", "norm", "angles", "positives").groupBy(*at)
    hard = left.cogroup(right).applyInArrow(_between(negatives, low, high), "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return hard.select(*out)
