"""Parity bits of sets: none of them rules a link out, and unlinked copies of one text do not become pairs."""

import random

import numpy as np
from test_pairs import brute_groups, edited

from foliotab.llm import neardup


def test_parity_bits_are_a_lower_bound():
    rng = np.random.default_rng(7)
    for n, m in [(1, 0), (40, 9), (300, 60), (3000, 500)]:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[m:], rng.integers(0, 2**64, m, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        whole = np.frombuffer(neardup.parity(a), np.uint64) ^ np.frombuffer(neardup.parity(b), np.uint64)
        few = (neardup.folded(neardup.parity(a)) ^ neardup.folded(neardup.parity(b))).view(np.uint64)
        assert np.bitwise_count(few).sum() <= np.bitwise_count(whole).sum() <= apart


def test_unlinked_copies_make_no_pairs(spark, monkeypatch):
    """150 copies of one text, each with edits of its own, of which few are linked."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {i: " ".join(edited(rng, base, 4)) for i in range(150)}
    want, _ = brute_groups(texts, 4)
    asked = []

    def counted(postings, near, verify, **more):
        def count(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return linked_groups(postings, near, count, **more)

    linked_groups = neardup.linked_groups
    monkeypatch.setattr(neardup, "linked_groups", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, size=4).collect()} == want
    assert sum(asked) < 1000
