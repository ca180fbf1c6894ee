"""A document's language does not depend on the rows around it."""

import math

import pytest
from foliotab.llm import langid

TRAIN = [("the cat and the dog sat there", "en"), ("le chat et la voiture sont ici", "fr"), ("a", "en"), ("", "fr"), (None, "en"), ("12", "fr"), ("I", "en")]
ODD = ["", "a", None, "I", "789", "the dog", "7", "le chat", "", "x"]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(TRAIN, "text string, lang string").coalesce(1))


def found(spark, texts, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    return {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(df, *model).collect()}


def test_rows_alone(spark, model):
    got = found(spark, ODD, model)
    assert [got[i][0] for i in range(len(ODD))] == ["und", "en", "und", "en", "und", "en", "und", "fr", "und", got[9][0]]
    assert got[9][0] in ("en", "fr")
    for i, text in enumerate(ODD):
        assert found(spark, [text], model)[0] == got[i]


@pytest.mark.parametrize("size", [1, 3])
def test_batches(spark, model, size):
    want = found(spark, ODD * 3, model)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        assert found(spark, ODD * 3, model) == want
        again = langid.fit(spark.createDataFrame(TRAIN, "text string, lang string").coalesce(1))
        assert again[0] == model[0] and (again[1] == model[1]).all()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sequences(text):
    low = "".join(c if c.isalpha() else "\x00" for c in (text or "").lower())
    spaced = " " + " ".join(" ".join(low.split("\x00")).split(" ")) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    spaced = " " + spaced.strip() + " "
    return [spaced[i : i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " "]


def test_brute_force(spark, model):
    """Counts of the sequences, smoothed, and the likelier language of a text of one window."""
    langs, table = model
    counts = {lang: {} for lang in langs}
    for text, lang in TRAIN:
        for s in sequences(text):
            counts[lang][s] = counts[lang].get(s, 0) + 1
    total = {lang: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for lang, c in counts.items()}
    for text in ("the dog", "le chat", "there", "ici", "and the", "a"):
        like = {lang: sum(math.log((counts[lang].get(s, 0) + langid.SMOOTH) / total[lang]) for s in sequences(text)) for lang in langs}
        assert found(spark, [text], model)[0][0] == max(like, key=like.get)
    assert table.shape == (langid.BUCKETS, 2)
