"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliotab.session import cut_lineage

LIST_ROWS = 256
SAMPLE_ROWS = 16_384
MOST_LISTS = 4_096
PAGE_ROWS = 2_048
COPIES = 3
COPY_RATIO = 1.05
#: Share of the sample's true neighbours that the distance ratio must reach.
TARGET = 0.97
TRIALS = 256
DEGREE = 24
BEAM = 32
#: One of so many entries, of the sample's, bounds the scores that a list sends on.
BOUND_SHARE = 8


def usable(vector: Column) -> Column:
    """Not null, not all zeros, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Centroids:
    """Centroids with a graph of near ones, searched by best-first expansion of a beam, many vectors at a time."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE):
        self.points = points.astype(np.float32)
        n = len(points)
        self.norms = (self.points**2).sum(1)
        near = self.distances(self.points, np.broadcast_to(np.arange(n), (n, n))) if n <= 2048 else None
        links = np.empty((n, min(degree, n)), np.int64)
        for i in range(n):
            row = near[i] if near is not None else self.norms - 2 * self.points @ self.points[i]
            links[i] = np.argsort(row, kind="stable")[: links.shape[1]]
        far = np.random.default_rng(7).integers(0, n, (n, 4))  # long links, so that no part is cut off
        self.links = np.concatenate([links, far], axis=1)
        self.start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def distances(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances from vector i to centroids ids[i]."""
        inner = np.einsum("bd,bkd->bk", vectors, self.points[ids], optimize=False)
        return np.maximum((vectors**2).sum(1)[:, None] + self.norms[ids] - 2 * inner, 0)

    def search(self, vectors: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids found for each vector and their squared distances, nearest first."""
        n, b = len(self.points), len(vectors)
        width, k = min(max(beam, k), n), min(k, n)
        ids = np.broadcast_to(self.start, (b, len(self.start))).copy()
        dist = self.distances(vectors, ids)
        open_ = np.ones(ids.shape, bool)
        steps = max(1, width // 16)
        while True:
            best = np.where(open_, dist, np.inf)
            many = min(steps, best.shape[1])
            pick = np.argpartition(best, many - 1, axis=1)[:, :many]
            live = np.isfinite(np.take_along_axis(best, pick, 1))
            chosen = np.flatnonzero(live.any(1))
            if not len(chosen):
                break
            pick, live = pick[chosen], live[chosen]
            open_[chosen[:, None], pick] &= ~live
            near = ids[chosen[:, None], np.where(live, pick, best[chosen].argmin(1)[:, None])]
            new = self.links[near].reshape(len(chosen), -1)
            merged = np.concatenate([ids[chosen], new], 1)
            gap = np.concatenate([dist[chosen], self.distances(vectors[chosen], new)], 1)
            fresh = np.concatenate([open_[chosen], np.ones(new.shape, bool)], 1)
            order = np.lexsort((fresh, merged), axis=1)  # of equal ids the one already expanded comes first
            merged, gap, fresh = (np.take_along_axis(x, order, 1) for x in (merged, gap, fresh))
            gap[:, 1:][merged[:, 1:] == merged[:, :-1]] = np.inf
            top = np.argsort(gap, axis=1, kind="stable")[:, :width]
            merged, gap, fresh = (np.take_along_axis(x, top, 1) for x in (merged, gap, fresh))
            if merged.shape[1] > ids.shape[1]:
                pad = merged.shape[1] - ids.shape[1]
                ids, dist, open_ = np.pad(ids, ((0, 0), (0, pad))), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf), np.pad(open_, ((0, 0), (0, pad)))
            ids[chosen], dist[chosen], open_[chosen] = merged, gap, fresh & np.isfinite(gap)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of ``n`` clusters of the sample; clusters that run empty or large are re-seeded from the largest ones."""
    rng = np.random.default_rng(11)
    points = sample[rng.choice(len(sample), n, replace=False)].astype(np.float64)
    for turn in range(rounds):
        owner = np.concatenate([((points**2).sum(1) - 2 * part @ points.T).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        counts = np.bincount(owner, minlength=n)
        sums = np.zeros_like(points)
        np.add.at(sums, owner, sample)
        points = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points)
        poor, rich = np.flatnonzero(counts < len(sample) / n / 4), np.argsort(-counts)
        for i, j in zip(poor, rich[: len(poor)]):
            if turn < rounds - 2 and counts[j] > 2 * len(sample) / n:
                points[i] = sample[rng.choice(np.flatnonzero(owner == j))]
    return points


def fit_ratio(centroids: Centroids, sample: np.ndarray, top: float, k: int, target: float) -> tuple[float, float, int]:
    """Distance ratio within which lists hold ``target`` of the true neighbours of ``TRIALS`` sample rows, the usual distance
    to the nearest centroid, and the most lists that any of these rows reads. The ratio is taken to the nearest centroid's
    distance, or the usual one if that is larger. Neighbours in a sample are farther than in the whole, so the share is
    no lower there.
    """
    tried = sample[:TRIALS]
    scores = tried @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    ids, dist = centroids.search(_lifted(sample, top).astype(np.float32), COPIES)
    held = np.sqrt(dist) <= COPY_RATIO * np.sqrt(dist[:, :1]) + 1e-9
    asked = np.concatenate([tried, np.zeros((len(tried), 1))], 1).astype(np.float32)
    away = np.sqrt(centroids.distances(asked, np.broadcast_to(np.arange(len(centroids.points)), (len(tried), len(centroids.points)))))
    usual = float(np.median(away.min(1)))
    ratio = away / np.maximum(np.maximum(away.min(1, keepdims=True), usual), 1e-12)
    least = np.where(held[near], ratio[np.arange(len(tried))[:, None, None], ids[near]], np.inf).min(2)
    limit = float(np.quantile(least, target, method="higher")) if least.size else 1.0
    return limit, usual, int((ratio <= limit).sum(1).max(initial=1))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> DataFrame:
    """The ``k`` nearest of all other rows for each row where ``is_query``: query_id, rank, vec_id, score.

    Nearest is the largest inner product in double precision, ties to the smaller id. Rows whose vector ``usable`` rejects,
    or whose id is null, take no part; of rows with one id and one vector one takes part.

    Equal vectors become one entry with the ``k`` + 1 smallest of their ids, which is all that any answer can use.
    Entries get one more component that makes all norms equal, so the nearest by distance has the largest inner product.
    Centroids are fitted on ``sample_rows`` entries (those of smallest hash); every entry is indexed: it goes to the list of
    its nearest centroid, and, near a boundary, to up to ``COPIES`` lists within ``COPY_RATIO`` of that distance. Lists
    are dealt in pages of about ``PAGE_ROWS`` so that none grows beyond a task. A query reads the lists within a ratio of
    the distance to its nearest centroid, set on the sample so that ``target`` of its true neighbours are within it;
    queries are dealt in blocks as well. With at most ``list_rows`` entries there is one list and the answer is exact.

    A list sends on the best of its entries only, and, but for a query's nearest lists, only those that reach the
    query's ``k`` + 1st best score among a share of the sample: no other entry can be among the nearest. Vectors travel as
    bytes, and scores under a query's number and hash.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    ranked = Window.partitionBy("h", "v").orderBy("id")
    rows = rows.withColumn("h", F.xxhash64("v"))
    entries = rows.select("h", "v", "id").distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    entries = cut_lineage(entries.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 at most
    asked = rows.where(F.coalesce("q", F.lit(False))).select("h", "v", F.col("id").alias("query_id")).distinct()
    queries = cut_lineage(asked.groupBy("h", "v").agg(F.min("query_id").alias("query")))
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], empty)
    n_lists = int(min(MOST_LISTS, max(1, size["n"] // list_rows), max(1, min(size["n"], sample_rows) // 4)))
    sample = np.array([r["v"] for r in entries.orderBy("h", "v").limit(sample_rows).select("v").collect()])
    centroids = Centroids(fit_centroids(_lifted(sample, size["top"]), n_lists))
    ratio, usual, probes = fit_ratio(centroids, sample, size["top"], k, target)

    seeds = sample[: max(k + 1, size["n"] // BOUND_SHARE)]
    tasks = vectors.sparkSession.sparkContext.defaultParallelism

    lists = entries.mapInArrow(_dealt(centroids, size["top"], COPIES, COPY_RATIO), "list int, h long, v binary, ids array<long>")
    lists = cut_lineage(lists)
    sizes = np.zeros(n_lists, np.int64)
    for row in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row["list"]] = row["n"]  # n_lists rows at most
    probe = _probed(centroids, probes, ratio, usual, sizes, COPIES * (k + 1), seeds, k + 1)
    probed = cut_lineage(queries.repartition(tasks, "h", "query").mapInArrow(probe, "list int, h long, query long, v binary, floor double"))
    pages = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("int").alias("pages"))
    blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("int").alias("blocks"))
    parts = F.broadcast(pages.join(blocks, "list"))  # a row for each list, of which there are MOST_LISTS at most
    # A page meets every block of its list: each side names its own part and is repeated for the other's.
    left = lists.join(parts, "list").withColumn("page", F.pmod("h", "pages").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = probed.join(parts, "list").withColumn("block", F.pmod("h", "blocks").cast("int")).withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    keys = ["list", "page", "block"]
    near = left.select(*keys, "v", "ids").groupBy(*keys).cogroup(right.select(*keys, "h", "query", "v", "floor").groupBy(*keys))
    found = near.applyInArrow(_scored(k + 1), "h long, query long, vec_id long, score double, ids array<long>")
    best = Window.partitionBy("h", "query").orderBy(F.desc("score"), "vec_id")
    # an entry comes from up to COPIES lists
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= COPIES * (k + 1)).drop("r").dropDuplicates(["h", "query", "vec_id"])
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    named = asked.join(queries, ["h", "v"]).select("h", "query", "query_id").join(found, ["h", "query"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0))[:, None]], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _bytes(v: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    width = v.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(0, (len(v) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _dealt(centroids: Centroids, top: float, copies: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                v = _matrix(part.column(1))
                ids, dist = centroids.search(_lifted(v, top).astype(np.float32), copies)
                row, place = np.nonzero(np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-9)
                h, _, members = part.take(pa.array(row)).columns
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, place], pa.int32()), h, _bytes(v[row]), members], names=["list", "h", "v", "ids"])

    return run


def _floors(v: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` th best score of each vector among the seeds, less what rounding may add."""
    if len(seeds) < k:
        return np.full(len(v), -np.inf)
    margin = 1e-9 * np.sqrt((v**2).sum(1) * (seeds**2).sum(1).max())
    return np.partition(v @ seeds.T, len(seeds) - k, axis=1)[:, len(seeds) - k] - margin


def _probed(centroids: Centroids, probes: int, ratio: float, usual: float, sizes: np.ndarray, least: int, seeds: np.ndarray, k: int):
    """The lists within the ratio, and in any case the nearest ones until they hold ``least`` entries, which no floor bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                h, query = part.column(0), part.column(2)
                v = _matrix(part.column(1))
                lifted = np.concatenate([v, np.zeros((len(v), 1))], 1).astype(np.float32)
                ids, dist = centroids.search(lifted, probes + probes // 4, max(BEAM, probes + probes // 4))
                before = np.cumsum(sizes[ids], axis=1) - sizes[ids]
                reach = np.sqrt(dist) <= ratio * np.maximum(np.sqrt(dist[:, :1]), usual) + 1e-9
                row, place = np.nonzero((reach | (before < least)) & np.isfinite(dist))
                floor = np.where(before < least, -np.inf, _floors(v, seeds, k)[:, None])[row, place]
                at_row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, place], pa.int32()), h.take(at_row), query.take(at_row), _bytes(v[row]), pa.array(floor)], names=["list", "h", "query", "v", "floor"])

    return run


def _scored(k: int):
    """The ``k`` best entries of a page, of those that reach its floor, for each query of a block."""
    names = ["h", "query", "vec_id", "score", "ids"]

    def run(page: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(page) and len(queries):
            vectors, asked = _unpacked(page.column("v")), _unpacked(queries.column("v"))
            members = page.column("ids").combine_chunks()
            first = pc.list_element(members, 0).to_numpy()
            h, query, floors = (queries.column(c).to_numpy() for c in ("h", "query", "floor"))
            longest = np.sqrt((vectors**2).sum(1).max())
            for at in range(0, len(asked), 64):
                part, need = asked[at : at + 64], floors[at : at + 64]
                rough = part @ vectors.T
                if len(vectors) > k:
                    margin = 1e-9 * longest * np.sqrt((part**2).sum(1))
                    need = np.maximum(need, np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k] - margin)
                q, v = np.nonzero(rough >= need[:, None])
                score = np.einsum("nd,nd->n", part[q], vectors[v])
                order = np.lexsort((first[v], -score, q))
                q, v, score = q[order], v[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, v, score = q[best], v[best], score[best]
                out.append(pa.table([pa.array(h[at + q]), pa.array(query[at + q]), pa.array(first[v]), pa.array(score), members.take(pa.array(v))], names=names))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, kinds))).empty_table()

    return run
