"""Tokens and sentences cut from whole texts."""

import random
import re

from foliotab.functions.tokens import TOKEN, Cut
from foliotab.operators import alignment as A


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_texts(rnd, n):
    parts = ["a", "B", "é", "Ü", "1", "9", "/", "/", " ", "\n", "\r", ".", "!", "Mr", "Mr.", "Dr", ",", "　", "\x85", "😀", "Prof"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25))) for _ in range(n)]


def test_tokens_are_those_of_the_pattern():
    rnd = random.Random(1)
    for _ in range(400):
        texts = odd_texts(rnd, rnd.randrange(0, 6))
        row, (idx, token, _, start, end, _, _) = Cut(texts).tokens()
        want = [(r, i, m[0], *m.span()) for r, t in enumerate(texts) for i, m in enumerate(re.finditer(TOKEN, t))]
        assert list(zip(row.tolist(), idx.to_pylist(), token.to_pylist(), start.to_pylist(), end.to_pylist())) == want


def test_whole_texts_without_token_rows(spark):
    texts = odd_texts(random.Random(2), 300)
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    tokens = A.tokenize(docs)
    cut = A.text_sentences(docs)
    assert answer(cut) == answer(A.sentences(tokens))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    spans = cut.select("doc_id", "first", "last").union(spark.createDataFrame([(1, 3, 3), (1, -1, 2), (1, 0, 999), (950, 0, 1)], "doc_id long, first int, last int"))
    assert answer(A.span_text(spans, None, docs)) == answer(A.span_text(spans, tokens, docs))
