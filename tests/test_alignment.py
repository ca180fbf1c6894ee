"""Quotes located over tables: repeated rows, many quotes of one document, missing documents, odd values."""

import difflib
import random

from foliotab.functions.quotes import split, stem
from foliotab.operators import alignment as A


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_parts_and_repeats_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "one two three. four five six."), (2, "a b c"), (3, None)], "doc_id long, text string")
    rows = [(1, i % 50, f"{['one two', 'two three', 'five', 'six one'][i % 4]}") for i in range(400)] + [(1, 0, "one two")] * 9 + [(9, 1, "a b"), (3, 1, "x"), (2, 1, None), (2, 2, ""), (None, 1, "a")]
    quotes = spark.createDataFrame(rows, "doc_id long, quote_id int, quote string")
    whole = answer(A.align_exact(quotes, docs))
    assert len(whole) == len(rows)
    assert answer(A._aligned(quotes, docs, "doc_id", True, False, None, part=7).drop("ratio")) == whole
    found = {r[2]: r[3:] for r in whole if r[0] == 1}
    assert found["two three"] == (1, 3, 4, 13, "two three", "MATCH_EXACT") and found["six one"] == (None,) * 6
    assert all(r[3:] == (None,) * 6 for r in whole if r[0] != 1)
    assert A.align_fuzzy(quotes.where("quote_id < 0"), docs).collect() == []


def test_fuzzy_over_tables_is_every_window(spark):
    """Same quotes accepted as by the search of all windows with the standard library's matching blocks."""
    rnd = random.Random(2)
    words = ["cat", "cats", "dog", "Runs", "run", "7", "a/b", ",", "tree"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 16)))) for i in range(25)]
    quotes = [(i, k, " ".join(rnd.choice([*words, "zz"]) for _ in range(rnd.randrange(1, 8)))) for i in range(25) for k in range(12)]
    got = {(r["doc_id"], r["quote_id"]): r for r in A.align_fuzzy(spark.createDataFrame(quotes, "doc_id long, quote_id int, quote string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, k, quote in quotes:
        source, want = [stem(w) for w in split(docs[i][1])], [stem(w) for w in split(quote)]
        share = 0.0
        for size in range(len(want), len(source) + 1):
            for at in range(len(source) - size + 1):
                share = max(share, sum(b.size for b in difflib.SequenceMatcher(None, source[at : at + size], want, autojunk=False).get_matching_blocks()) / len(want))
        row = got.get((i, k))
        assert (row is not None) == (share >= 0.75)
        if row:
            assert docs[i][1][row["start_pos"] : row["end_pos"]] == row["span_text"] and row["ratio"] >= 0.75


def test_sentences_and_spans(spark):
    docs = spark.createDataFrame([(1, "Dr. Who left.\nThen he  came\r\nback! ok"), (2, ""), (3, None), (4, "No end")], "doc_id long, text string")
    tokens = A.tokenize(docs)
    s = A.sentences(tokens)
    assert answer(s.select("doc_id", "sentence", "first", "last", "text")) == [
        (1, 0, 0, 5, "Dr. Who left."), (1, 1, 5, 10, "Then he  came\r\nback!"), (1, 2, 10, 11, "ok"), (4, 0, 0, 2, "No end"),
    ]
    spans = A.span_text(s.drop("text", "start", "end"), tokens, docs)
    assert {(r["doc_id"], r["sentence"], r["span"]) for r in spans.collect()} == {(r["doc_id"], r["sentence"], r["text"]) for r in s.collect()}
    bad = spark.createDataFrame([(1, 3, 3), (1, 5, 2), (1, 0, 99), (1, -1, 2), (7, 0, 1)], "doc_id long, first int, last int")
    assert {r["span"] for r in A.span_text(bad, tokens, docs).collect()} == {None}


def test_carriage_return_is_marked(spark):
    docs = spark.createDataFrame([(1, "one\rTwo\nthree")], "doc_id long, text string")
    assert [(r["token"], r["after_newline"]) for r in A.tokenize(docs).orderBy("idx").collect()] == [("one", False), ("Two", True), ("three", True)]
    assert A.sentences(A.tokenize(docs)).count() == 1
