"""Token counts and packing against the library itself, and an exact round trip."""

import zlib

import numpy as np
import pytest
from edge_rows import ROWS, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from foliotab.llm import bpe, packing, token_counts

ODD = [
    "a<|endoftext|>b c", "<|endoftext|>", "<|endoftext", " lead", "trail ", "two  spaces", "tabs\t\tand\n\nlines \n x", "don't DON'T 'sfoo 'S",
    "   x\x1c\x85y  z", "日本語 テキスト 😀😀 é", "՘a ՘ b", "x퟿\U0001d6a6 1\U0001247f2", "12345 6 7.8e9", "a" * 5000, "word " * 3000, "�\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    return bpe.Vocabulary(token_counts.default_vocabulary())


@pytest.fixture(scope="module")
def memo(library):
    whole = library.whole_tokens()
    little = lambda ids: np.asarray(ids, "<u4").tobytes()
    table = bpe.Memo(library, {t: little([i]) for t, i in whole.items()}, lambda p: little(library.merge(p.encode())), b"".join)
    return lambda text: np.frombuffer(table.encode(text, lambda i: little([i]), lambda p: little(library.library.encode(p, add_special_tokens=False).ids)), "<u4").tolist()


def test_odd_texts(library, memo):
    for text in ODD:
        assert memo(text) == library.library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'aAsé1.,<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(library, memo, text):
    assert memo(text) == library.library.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proven(library):
    whole = library.whole_tokens()
    assert len(whole) > 49_000
    assert all(library.pieces(t) == [t] for t in whole)
    assert "don't" not in whole and " the" in whole


def test_counts(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for row in token_counts.token_counts(docs, limit=3).collect():
        text = ODD[row["doc_id"]]
        n = len(library.library.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 3)


def test_count_edges(spark):
    rows = token_counts.token_counts(edge_docs(spark)).collect()
    assert len(rows) == len(ROWS)
    assert [(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (3, 4)] == [(0, 0), (0, 0)]
    assert token_counts.token_counts(empty_docs(spark)).count() == 0


def round_trip(rows, texts, library):
    """``rows`` of pieces against the texts (a list: documents of one id are told apart by nothing)."""
    ids = {d: library.library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    at = {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r["ids_crc32"]
        at.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(at) == set(ids)
    for d, pieces in at.items():
        pieces.sort()
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) == len(ids[d])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"], r["step_group"]))
    padded = 0
    for pieces in sequences.values():
        pieces.sort()
        total = sum(p[1] for p in pieces)
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [p[1] for p in pieces])[:-1]) and total <= 1024
        assert len({(p[2], p[3]) for p in pieces}) == 1 and pieces[0][2] in (0, total)
        padded += 0 if total & (total - 1) == 0 else 1024 - total
    return padded


def test_pack_round_trip(spark, library):
    texts = {i: ("word %d " % i) * (i * 7 % 900) for i in range(120)} | {1000 + i: t for i, t in enumerate(ODD)} | {2000: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    padded = round_trip(packing.pack(docs, block_tokens=20_000).collect(), texts, library)
    assert padded <= 1024 * 12  # at most one remainder a block


def test_step_groups_are_balanced(spark):
    docs = spark.createDataFrame([(i, "some words here " * (20 + i % 300)) for i in range(400)], "doc_id long, text string").coalesce(1)
    groups = {}
    for r in packing.pack(docs, step_tokens=8192).where("offset = 0 and window > 0").collect():
        groups.setdefault((r["step_group"], r["window"]), 0)
        groups[r["step_group"], r["window"]] += 1
    assert len({g for g, _ in groups}) == len(groups)  # one shape in a group
    for window in packing.TIERS:
        sizes = [n for (_, w), n in groups.items() if w == window]
        assert not sizes or max(sizes) - min(sizes) <= 1


def test_pack_edges(spark):
    rows = packing.pack(edge_docs(spark)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1 == sum(r["length"] for r in rows if r["doc_id"] == 4)
    assert sum(r["start"] == 0 for r in rows) == len(ROWS)
    assert packing.pack(empty_docs(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 63, 64, 65, 127, 128, 500, 512, 1000, 1023, 1024, 1025, 3000]), max_size=12))
def test_windows_hold_each_token_once(lengths):
    seen = set()
    short = 0
    for window, pieces in packing.plan_windows(lengths):
        assert window == sum(n for _, _, n in pieces)
        short += window not in packing.TIERS
        for i, start, n in pieces:
            own = {(i, k) for k in range(start, start + n)}
            assert not own & seen
            seen |= own
    assert len(seen) == sum(lengths) and short <= 1
