"""Importance resampling against a plain count, text by text."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest
from edge_rows import edge_docs, empty_docs

from foliotab.llm import resample
from foliotab.llm.words import utf8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, ngram):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, ngram, buckets, seed, least, percent):
    place = lambda f: crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text, ngram)[0]:
                counts[place(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found, words = runs(text, ngram)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], (r[0] is not None, r[0]), -r[2], -r[1]))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :] + [r for r in rows if r[4] < least]], key=repr)


def answer(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


TEXTS = ["The cat sat on the mat, the cat", "Ünï cödé 12 CAT mat", "one", "", None, "mat " * 40, "a-b c_d e.f", "\x00cat\x00mat", "the mat sat"]


@pytest.mark.parametrize("ngram", [1, 2, 3])
@pytest.mark.parametrize("buckets", [7, 1000])
def test_brute(spark, ngram, buckets):
    docs = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "cat mat sat on"), (3, "the cat"), (3, "the cat")]
    target = ["the cat sat", None, "", "on the mat"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = answer(resample.resample(df, goal, ngram=ngram, buckets=buckets, seed=5, min_words=2, percent=40))
    assert got == brute(docs, target, ngram, buckets, 5, 2, 40)


def test_no_run_crosses_texts():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["a b", "", None, "c", "d e f"]))
    text, starts = resample.joined(data, offsets)
    doc, _, words = resample.features(text, starts, 3, 1 << 20)
    assert words.tolist() == [2, 0, 0, 1, 3]
    assert np.bincount(doc, minlength=5).tolist() == [3, 0, 0, 1, 6]


def test_slices_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} the x{i % 3}") for i in range(50)], "doc_id long, text string")
    want = answer(resample.resample(docs, docs, min_words=1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert answer(resample.resample(docs, docs, min_words=1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edge_rows(spark):
    docs, none = edge_docs(spark), empty_docs(spark)
    rows = resample.resample(docs, docs.select("text"), min_words=5, percent=100).collect()
    assert len(rows) == docs.count()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 7))
    assert all(r["n_features"] == 0 and r["weight"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert {r["n_features"] for r in rows if r["doc_id"] in (7, 8)} == {20000, 20001}
    assert resample.resample(none, none).collect() == []
    assert len(resample.resample(docs, none).collect()) == len(rows)
