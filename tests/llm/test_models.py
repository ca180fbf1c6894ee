"""Nearest neighbours, languages and toxicity: exactness where it is promised, held-out accuracy otherwise."""

import math

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import ROWS, edge_docs, empty_docs
from pyspark.sql import functions as F

from foliotab.llm import ann, langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_nearest(ids, vectors, asked, k):
    out = {}
    for q in asked:
        i = ids.index(q)
        scores = [(-float(np.dot(vectors[i], v)), j) for j, v in zip(ids, vectors) if j != q]
        out[q] = [j for _, j in sorted(scores)[:k]]
    return out


def make(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")


def test_one_list_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).astype(np.float32).astype(float)
    rows = ann.search(make(spark, range(200), v), F.col("vec_id") % 20 == 0, k=20).collect()
    want = brute_nearest(list(range(200)), v, range(0, 200, 20), 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(v[r["query_id"]], v[r["vec_id"]])), abs=1e-12)
    assert got == want


@pytest.mark.parametrize("kind", ["round", "clustered", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    n = 3000
    v = rng.normal(size=(n, 32))
    if kind == "clustered":
        v = rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.2 * v
    if kind != "lengths":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.astype(np.float32).astype(float)
    rows = ann.search(make(spark, range(n), v), F.col("vec_id") % 20 == 0, k=20, list_rows=100).collect()
    want = brute_nearest(list(range(n)), v, range(0, n, 20), 20)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(x) == 20 for x in got.values()) and set(got) == set(want)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.93


def test_equal_vectors_and_useless_ones(spark):
    """A third of all rows is one vector: ties go to the smallest ids; null, zero and non-finite vectors stay out."""
    rng = np.random.default_rng(3)
    v = [rng.normal(size=6) for _ in range(300)]
    v[100:200] = [v[100]] * 100
    v[20], v[40], v[60], v[80] = None, np.zeros(6), np.full(6, np.nan), np.full(6, np.inf)
    df = make(spark, range(300), v).unionByName(spark.createDataFrame([(None, [1.0] * 6), (140, [float(x) for x in v[140]])], "vec_id long, embedding array<float>"))
    df = df.union(spark.createDataFrame([(301, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "vec_id long, embedding array<float>"))
    df = df.withColumn("h", F.lit("clash")).withColumn("list", F.lit(1)).withColumn("ids", F.lit(None).cast("int"))
    rows = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    good = [i for i in range(300) if i not in (20, 40, 60, 80)]
    want = brute_nearest(good, [np.asarray(v[i], np.float32).astype(float) for i in good], [i for i in good if i % 20 == 0], 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(600, 16))
    graph = ann.Centroids(points)
    asked = rng.normal(size=(200, 16)).astype(np.float32)
    ids, dist = graph.search(asked, 3)
    full = ((asked[:, None] - points[None]) ** 2).sum(2)
    assert np.mean(ids[:, 0] == full.argmin(1)) > 0.97
    assert np.allclose(dist, np.take_along_axis(full, ids, 1), atol=1e-3) and (np.diff(dist, axis=1) >= 0).all()


def test_languages_held_out(spark):
    rows = queries.op5_languages(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = langid.fit(docs)
    texts = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(5).collect()) for x in ("en", "fr")}
    mixed = spark.createDataFrame([(1, texts["en"][:3000] + "\n" + texts["fr"][:1500])], "doc_id long, text string")
    found = langid.identify(mixed, langs, model).first()
    assert found["lang_pred"] == "en" and set(found["languages"]) == {"en", "fr"}
    assert found["languages"]["fr"] == pytest.approx(1 / 3, abs=0.08)


def test_mixture_likelihood_rises():
    """The steps find the shares of a made-up mixture, and one language where there is one."""
    rng = np.random.default_rng(5)
    own = rng.choice(3, 900, p=[0.6, 0.4, 0.0])
    like = np.where(np.arange(3) == own[:, None], -2.0, -6.0).astype(np.float32)
    share, chosen = langid.mixtures(np.concatenate([like, like[own == 1]]), np.array([0, 900]))
    assert chosen.tolist() == [2, 1]
    assert share[0] == pytest.approx([np.mean(own == 0), np.mean(own == 1), 0], abs=0.03) and share[1] == pytest.approx([0, 1, 0])


def test_language_edges(spark):
    langs, model = langid.fit(edge_docs(spark))
    rows = langid.identify(edge_docs(spark), langs, model).collect()
    assert len(rows) == len(ROWS)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(r["lang_pred"] in ("en", "") for r in rows if r["doc_id"] in (1, 2, 6, 7))
    langs, model = langid.fit(empty_docs(spark))
    assert langs == [] and {r["lang_pred"] for r in langid.identify(edge_docs(spark), langs, model).collect()} == {"und"}


def small_index():
    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(40)]
    idf = {f: float(rng.uniform(0.2, 4)) for f in names}
    examples = [(1000 + i, int(rng.random() < 0.3), 1.0, {f: int(rng.integers(1, 4)) for f in rng.choice(names, rng.integers(0, 9), replace=False)}) for i in range(700)]
    return toxicity.Index(idf, examples), names, rng


def test_block_max_search_is_exact():
    index, names, rng = small_index()
    for _ in range(150):
        query = index.vector({f: int(rng.integers(1, 5)) for f in rng.choice(names, rng.integers(1, 7), replace=False)})
        scores = [sum(w * v.get(f, 0.0) for f, w in query.items()) for v in index.vectors]
        want = sorted(((-round(s, 12), i) for i, s in enumerate(scores) if s > 0))[:15]
        got = index.nearest(query, 15)
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want])


def test_scores_are_chances():
    index, _, _ = small_index()
    assert 0 <= index.prior <= 1 and math.isfinite(index.slope)
    none = toxicity.Index({}, [])
    assert none.score("any text") == (0.0, [])


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op8_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in toxic]) > 0.7
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.04
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["evidence"] for r in toxic if r["predicted"])


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (7, None), (None, 1), (8, 5)], "doc_id long, toxic int")
    index = toxicity.fit(edge_docs(spark), labels)
    scored = edge_docs(spark).select("doc_id", toxicity.toxicity(F.coalesce("text", F.lit("")), index).alias("t")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["t"]["score"] <= 1 for r in scored)
    for nothing in (toxicity.fit(empty_docs(spark), labels), toxicity.fit(edge_docs(spark), labels.where("false"))):
        assert nothing.score("one two")[0] == 0.0


def test_lists_send_on_only_what_may_be_among_the_nearest():
    """Beyond a query's nearest lists, an entry below the bound by the sample stays where it is."""
    rng = np.random.default_rng(9)
    vectors, asked = rng.normal(size=(2000, 16)), rng.normal(size=(8, 16))
    floors = ann._floors(asked, vectors[:500], 21)
    kth = np.sort(asked @ vectors[:500].T, axis=1)[:, -21]
    assert (floors <= kth).all() and np.allclose(floors, kth)
    queries = pa.table({"h": list(range(8)), "query": list(range(8)), "v": ann._bytes(asked), "floor": floors})
    rows = 0
    for at in range(0, 2000, 100):
        page = pa.table({"v": ann._bytes(vectors[at : at + 100]), "ids": [[i] for i in range(at, at + 100)]})
        sent = ann._scored(21)(page, queries).to_pylist()
        rows += len(sent)
        assert all(r["score"] >= floors[r["query"]] for r in sent)
        best = {(q, at + v) for q, v in zip(*np.nonzero(asked @ vectors[at : at + 100].T >= np.sort(asked @ vectors.T, axis=1)[:, -21][:, None]))}
        assert best <= {(r["query"], r["vec_id"]) for r in sent}
    assert rows < 8 * 20 * 21 / 3
