"""Toxicity by nearest labelled examples: TF-IDF cosine over marker features, exact by a block-max index, distance-weighted votes."""

from __future__ import annotations

import copy
import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliotab.llm.worker import kept
from foliotab.session import cut_lineage

EXAMPLES = 3_000
FEATURES = 4_096
NEIGHBOURS = 15
BLOCK = 512
STEMS = (4, 5, 6)
#: A feature has this many examples of label 1 at least, is this many standard errors more frequent among them than among
#: the others, and this many times as frequent.
LEAST, APART, TIMES = 3, 4.0, 2.0

words = re.compile(r"[^\W\d_]{2,}").findall


def features(text: str) -> list[str]:
    """Words in lower case, and the first letters of longer words with a mark behind them."""
    out = words(text.lower())
    return out + [w[:n] + "*" for w in out for n in STEMS if len(w) > n]


class Index:
    """Labelled examples as unit TF-IDF vectors over chosen features, in blocks of examples.

    For each feature it holds the examples' weights as sparse postings and, for each block of ``BLOCK`` examples, the
    largest weight. A query takes blocks from the largest upper bound down and stops when no further block can hold a
    nearer example, so the nearest are exact; ties go to the example that comes first.
    """

    def __init__(self, idf: dict[str, float], examples: list[tuple[int, int, float, dict[str, int]]]):
        """``examples``: (id, label, weight in calibration, counts of features)."""
        self.idf = idf
        self.starts = frozenset(f[: STEMS[0]].rstrip("*") for f in idf)
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        self.blocks = max(1, -(-len(examples) // BLOCK))
        postings: dict[str, list[tuple[int, float]]] = {}
        self.vectors = [self.vector(e[3]) for e in examples]
        for i, v in enumerate(self.vectors):
            for f, w in v.items():
                postings.setdefault(f, []).append((i, w))
        self.postings, self.tops = {}, {}
        for f, rows in postings.items():
            at, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            top = np.zeros(self.blocks)
            np.maximum.at(top, at // BLOCK, w)
            self.postings[f], self.tops[f] = (at, w, np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)), top
        self.prior = self.slope = self.shift = 0.0
        self.calibrate(np.array([e[2] for e in examples], float))

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        raw = {f: (1 + math.log(n)) * self.idf[f] for f, n in counts.items() if f in self.idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {f: x / norm for f, x in raw.items()} if norm else {}

    def counts(self, text: str) -> dict[str, int]:
        """Counts of the chosen features of a text."""
        starts, first = self.starts, STEMS[0]
        found: Counter = Counter()
        for w in [w for w in words(text.lower()) if w[:first] in starts]:
            found[w] += 1
            for n in STEMS:
                if len(w) > n:
                    found[w[:n] + "*"] += 1
        return {f: n for f, n in found.items() if f in self.idf}

    def nearest(self, query: dict[str, float], k: int, leave_out: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the ``k`` nearest examples with a positive cosine, nearest first."""
        terms = [(q, *self.postings[f], self.tops[f]) for f, q in query.items() if f in self.postings]
        if not terms:
            return []
        bound = sum(q * top for q, _, _, _, top in terms)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] + 1e-12 < -best[-1][0]):
                break
            score = np.zeros(BLOCK)
            for q, at, w, cuts, _ in terms:
                lo, hi = cuts[b], cuts[b + 1]
                score[at[lo:hi] - b * BLOCK] += q * w[lo:hi]
            found = [(-round(float(score[i]), 12), b * BLOCK + int(i)) for i in np.flatnonzero(score > 0)]
            best = sorted(best + [x for x in found if x[1] != leave_out])[:k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1, by squared cosines; one vote at half similarity for the examples' own share."""
        weight = np.array([s * s for s, _ in near])
        return float((weight @ self.labels[[i for _, i in near]] + 0.25 * self.prior) / (weight.sum() + 0.25)) if near else self.prior

    def calibrate(self, weight: np.ndarray) -> None:
        """Logistic curve from votes to scores, fitted on each example's vote without itself; prior without features."""
        if not len(weight):
            return
        bare = np.array([not v for v in self.vectors])
        rate = lambda m: float((weight[m] @ self.labels[m] + 0.5 * weight.mean()) / (weight[m].sum() + weight.mean()))
        self.prior = rate(bare)
        some = np.flatnonzero(~bare)
        if not len(some):
            return
        x = np.array([self.vote(self.nearest(self.vectors[i], NEIGHBOURS, i)) for i in some])
        y, w = self.labels[some], weight[some] / weight[some].mean()
        # a soft target keeps the curve finite where votes part the labels
        y = np.where(y > 0, 1 - 1 / (w @ y + 2), 1 / (w @ (1 - y) + 2))
        theta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
            grad = np.array([w @ ((p - y) * x), w @ (p - y)]) + 1e-3 * theta
            h = w * np.maximum(p * (1 - p), 1e-6)
            theta = theta - np.linalg.solve(np.array([[h @ (x * x) + 1e-3, h @ x], [h @ x, h.sum() + 1e-3]]), grad)
        self.slope, self.shift = theta

    def without_vectors(self) -> Index:
        """A copy for scoring; the examples' own vectors only serve to calibrate."""
        out = copy.copy(self)
        out.vectors = []
        return out

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        query = self.vector(self.counts(text))
        near = self.nearest(query, NEIGHBOURS) if query else []
        if not near:
            return self.prior, []
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * self.vote(near) + self.shift)))), near


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Index of at most ``examples`` labelled documents of each class (those of smallest id hash), equal texts once.

    ``labels`` has ids and labels 0 or 1; other labels, null ids and null texts teach nothing. Features are the words and
    word beginnings that mark label 1 among these examples, ``FEATURES`` of the clearest at most. Everything that
    reaches the driver is bounded by these parameters. Examples of one class alone teach nothing: all texts then score 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    turn = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    known = cut_lineage(known)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= examples).drop("turn")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    taught = texts.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"), F.min_by("label", "id").alias("label"))  # a few thousand
    taught = cut_lineage(taught)
    counts = taught.mapInArrow(_feature_rows, "id long, label int, feature string, n int")
    sizes = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Index({}, [])
    per = counts.groupBy("feature").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("df")).withColumn("q", F.col("df") - F.col("p"))
    share = F.col("df") / (pos + neg)
    gap = (F.col("p") / pos - F.col("q") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-9)
    often = F.col("p") / pos >= TIMES * F.col("q") / neg
    clear = per.where((F.col("p") >= LEAST) & often).withColumn("gap", gap).where(F.col("gap") >= APART)
    top = clear.orderBy(F.desc("gap"), "feature").limit(FEATURES).select("feature", "df").collect()
    idf = {r["feature"]: math.log((1 + pos + neg) / (1 + r["df"])) + 0.1 for r in top}
    rows = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(f,) for f in idf], "feature string")), "feature").select("id", "feature", "n").collect() if idf else []
    own: dict[int, dict[str, int]] = {}
    for r in rows:
        own.setdefault(r["id"], {})[r["feature"]] = r["n"]
    order = sorted(taught.select("id", "label").collect(), key=lambda r: r["id"])
    return Index(idf, [(r["id"], r["label"], shares[r["label"]] / sizes[r["label"]], own.get(r["id"], {})) for r in order])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label"))):
            counts = Counter(features(text))
            n = len(counts)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int32())], names=["id", "label", "feature", "n"])


def toxicity(text: Column, index: Index) -> Column:
    """struct(score, evidence): calibrated score of each whole text (null: empty), and its nearest examples, nearest first.

    A text without any feature of the index scores the examples' share of label 1 among such texts. The index travels as
    bytes that a worker opens once, not once a task.
    """
    packed = cloudpickle.dumps(index.without_vectors())
    digest = hashlib.blake2b(packed).hexdigest()

    @F.arrow_udf("score double, evidence array<struct<example:bigint,cosine:double,label:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = kept(("toxicity", digest), lambda: pickle.loads(packed))
        for texts in batches:
            scores, evidence = [], []
            for t in texts:
                score, near = index.score(t.as_py() or "")
                scores.append(score)
                evidence.append([{"example": index.ids[i], "cosine": s, "label": int(index.labels[i])} for s, i in near])
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["score", "evidence"])

    return run(text)
