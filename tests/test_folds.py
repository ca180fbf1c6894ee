import random
import time

from foliotab.functions import folds
from foliotab.operators import documents


def paths(lines):
    """Active titles per line, each found by looking back over all lines."""
    for i in range(len(lines)):
        out = {}
        heads = [(j, len(folds.HEAD.match(x)[1]), x.split(" ", 1)[1].strip(" ")) for j, x in enumerate(lines[: i + 1]) if folds.HEAD.match(x)]
        for level in range(1, 7):
            own = [h for h in heads if h[1] == level]
            if own and not any(h[0] > own[-1][0] and h[1] < level for h in heads):
                out[f"Header {level}"] = own[-1][2]
        yield out


def test_split_headers(spark):
    rnd = random.Random(9)
    line = lambda: rnd.choice(["", "  ", "text", "# a ", "## b", "### c", "###### d", "####### no", "#no", "# e # f", "## "])
    texts = {i: "\n".join(line() for _ in range(rnd.randrange(0, 25))) for i in range(40)}
    df = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string")
    got = {}
    for r in documents.split_headers(df).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.metadata))
    want = {}
    for i, text in texts.items():
        parts = []
        for x, path in zip(text.split("\n"), paths(text.split("\n"))):
            if folds.HEAD.match(x) or not parts:
                parts.append(([], path))
            parts[-1][0].append(x)
        parts = [("\n".join(ls), path) for ls, path in parts]
        if kept := [p for p in parts if p[0].strip(" ")]:
            want[i] = kept
    assert got == want
    bare = documents.split_headers(spark.createDataFrame([("# a\nx\n## b\ny",)], "text string"), strip_headers=True).collect()
    assert [(r.content, r.metadata) for r in bare] == [("x", {"Header 1": "a"}), ("y", {"Header 1": "a", "Header 2": "b"})]


def test_long_documents_take_linear_time():
    lines = ["# h", "some words here.", "## i", "", "more.\n"] * 20_000
    text = "\n".join(lines)
    t0 = time.time()
    assert sum(1 for _ in folds.header_sections(text, False)) == 40_000
    assert sum(len(c) for c, _ in folds.packed(text, 400, 0)) == len(text)
    assert sum(len(c) for c, _ in folds.packed(text, 400, 100)) > len(text)
    assert time.time() - t0 < 10


def test_rows_of_some_texts_at_a_time():
    """No more texts' rows than asked for are Python objects at once."""
    import gc

    import pyarrow as pa

    from foliotab.operators.documents import _lists

    class Row(dict):
        pass

    seen = []

    def rows(text):
        seen.append(sum(isinstance(x, Row) for x in gc.get_objects()))
        return [Row(t=w) for w in text.split()]

    texts = pa.array([f"a b{i} c" for i in range(300)] + [None, ""])
    got = _lists(texts, pa.list_(pa.struct([("t", pa.string())])), rows, some=20)
    assert got.to_pylist() == [[{"t": w} for w in (t or "").split()] for t in texts.to_pylist()]
    assert max(seen) <= 2 * 20 * 3
