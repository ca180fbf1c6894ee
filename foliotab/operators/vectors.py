"""Exact nearest neighbours by cosine, in blocks.

Rows are cut into blocks of bounded size; each pair of blocks is one task that multiplies two small matrices and
returns k rows per query, so no pair list is ever built and a large group spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import ship_by_value

ship_by_value(__name__)

BLOCK = 8192
#: Queries of a block whose similarities are held at once, and candidates that give one maximum.
STRIP = 512
RUN = 64
DIGITS = 9


def _nearest(x: np.ndarray, ids_a: np.ndarray, y: np.ndarray, ids_b: np.ndarray, k: int, cut: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, similarity) of the k best candidates per query, ties to the smaller id.

    The k-th largest maximum of runs of candidates is a lower bound of the k-th similarity, so only the few pairs from it on
    are rounded and sorted.
    """
    sim = x @ y.T
    if cut is not None:
        sim[ids_a[:, None] == ids_b[None, :]] = -np.inf
    tops = np.maximum.reduceat(sim, np.arange(0, sim.shape[1], RUN if sim.shape[1] >= k * RUN else 1), axis=1)
    bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] if tops.shape[1] >= k else np.full(len(x), -np.inf)
    if cut is not None:
        bound = np.maximum(bound, cut)
    row, at = np.divmod(np.flatnonzero(sim >= (bound - 2 * 10.0**-DIGITS)[:, None]), sim.shape[1])
    value, other = np.round(sim[row, at], DIGITS), ids_b[at]
    ok = np.isfinite(value) if cut is None else value >= cut
    row, value, other = row[ok], value[ok], other[ok]
    order = np.lexsort((other, -value, row))
    row = row[order]
    order, row = (z[np.arange(len(row)) - np.searchsorted(row, row) < k] for z in (order, row))
    return ids_a[row], other[order], value[order]


def _blocked(left: DataFrame, right: DataFrame, k: int, schema: str, cut: float | None) -> DataFrame:
    keys = ["__g", "__lb", "__rb"]

    def top(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["__g", "query_id", "vec_id", "similarity"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in cols})
        x, y = np.stack(a["v"].to_numpy()).astype(np.float64), np.stack(b["r_v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        ids_a, ids_b = a["id"].to_numpy(), b["r_id"].to_numpy()
        # a vector with a component that is no number is near nothing
        good_a, good_b = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
        x, ids_a, y, ids_b = x[good_a], ids_a[good_a], y[good_b], ids_b[good_b]
        found = [_nearest(x[i : i + STRIP], ids_a[i : i + STRIP], y, ids_b, k, cut) for i in range(0, len(x), STRIP)] if len(y) else []
        columns = [np.concatenate(c) for c in zip(*found)] or [ids_a[:0], ids_b[:0], np.zeros(0)]
        return pd.DataFrame({"__g": a["__g"].iloc[0], **dict(zip(cols[1:], columns))})

    # fresh column names, as both sides may come from one table
    other = right.toDF(*[f"r_{c}" for c in right.columns])
    return left.groupBy(*keys).cogroup(other.groupBy(*[f"r_{c}" for c in keys])).applyInPandas(top, schema)


def _blocks(df: DataFrame, sizes: DataFrame, mine: str, other: str, own: str, theirs: str) -> DataFrame:
    """Own block by hash of the id, repeated for each block of the other side."""
    j = df.join(sizes, "__g")
    return (
        j.withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)))
        .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        .select("__g", "__lb", "__rb", "id", "v")
    )


def _size(df: DataFrame, name: str, block: int) -> DataFrame:
    return df.groupBy("__g").agg(F.ceil(F.count("*") / block).alias(name))


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def knn(queries: DataFrame, vectors: DataFrame, k: int = 8, block: int = BLOCK) -> DataFrame:
    """``queries(id, v)`` against ``vectors(id, v)``: (query_id, vec_id, similarity, rank)."""
    q, x = queries.select(F.lit(0).alias("__g"), "id", "v"), vectors.select(F.lit(0).alias("__g"), "id", "v")
    sizes = _size(q, "ql", block).join(_size(x, "xl", block), "__g")
    near = _blocked(_blocks(q, sizes, "ql", "xl", "__lb", "__rb"), _blocks(x, sizes, "xl", "ql", "__rb", "__lb"), k, f"__g int, query_id {_kind(queries)}, vec_id {_kind(vectors)}, similarity double", None)
    top = ordered.top_per_group(near, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], k)
    return top.select("query_id", "vec_id", "similarity", "rank")


def context_text(hits: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Hits of each query as one text, best first; at most k rows per query."""
    j = hits.join(texts, "vec_id")
    item = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(text)).alias("t"))
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("context"))


def chunk_graph(chunks: DataFrame, k: int = 3, threshold: float = 0.8, block: int = BLOCK, width: int | None = None, order: str = "id") -> DataFrame:
    """Undirected edges of ``chunks(doc, id, v)``: ``order`` (a number or time; weight 1) and the k nearest with similarity >= threshold.

    An edge both ways counts once; a sequential edge wins over a semantic one.
    """
    seq = ordered.neighbours(chunks.select(*dict.fromkeys(["doc", "id", order])), ["doc"], order, following={"dst": F.col("id")}, width=width).filter("dst is not null")
    seq = seq.select("doc", F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"), F.lit("sequential").alias("edge_type"))
    x = chunks.select(F.col("doc").alias("__g"), "id", "v")
    sizes = _size(x, "n", block)
    kind = chunks.schema["doc"].dataType.simpleString()
    near = _blocked(_blocks(x, sizes, "n", "n", "__lb", "__rb"), _blocks(x, sizes, "n", "n", "__rb", "__lb"), k, f"__g {kind}, query_id {_kind(chunks)}, vec_id {_kind(chunks)}, similarity double", threshold)
    top = ordered.top_per_group(near, ["__g", "query_id"], [F.col("similarity").desc(), F.col("vec_id")], k)
    sem = top.select(F.col("__g").alias("doc"), F.least("query_id", "vec_id").alias("src"), F.greatest("query_id", "vec_id").alias("dst"), F.col("similarity").alias("weight"), F.lit("semantic").alias("edge_type"))
    # "semantic" < "sequential"
    return seq.unionByName(sem).groupBy("doc", "src", "dst").agg(F.max_by("weight", "edge_type").alias("weight"), F.max("edge_type").alias("edge_type"))


def neighbor_context(graph: DataFrame, texts: DataFrame, top: int = 5) -> DataFrame:
    """Texts of the heaviest neighbours, earlier and later ones apart; ``texts(doc, id, text)``."""
    both = graph.select("doc", F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(graph.select("doc", F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    best = ordered.top_per_group(both, ["doc", "id"], [F.col("weight").desc(), F.col("other")], top)
    j = best.join(texts.select("doc", F.col("id").alias("other"), "text"), ["doc", "other"])

    def joined(cond):
        items = F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "text"))))
        return F.array_join(F.transform(items, lambda x: x["text"]), "\n")

    agg = j.groupBy("doc", "id").agg(joined(F.col("other") < F.col("id")).alias("previous_context"), joined(F.col("other") > F.col("id")).alias("next_context"))
    return texts.select("doc", "id").join(agg, ["doc", "id"], "left").fillna("", ["previous_context", "next_context"])
