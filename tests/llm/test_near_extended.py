"""Near duplicates where one text is the other with text added or cut off."""

import random

from test_pairs import brute_groups

from foliotab.llm import neardup


def test_truncated_and_extended_copies(spark):
    rng = random.Random(11)
    texts = {}
    for g in range(500):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(rng.choice([420, 420, 1000]))]
        texts[2 * g] = " ".join(base)
        texts[2 * g + 1] = " ".join(base[: int(len(base) * 0.8) + 2 + rng.randrange(3)])
    sets = {g: brute_groups({d: texts[d] for d in (2 * g, 2 * g + 1)}, 4)[0] for g in range(500)}
    want = {d: root for found in sets.values() for d, root in found.items()}
    assert sum(root != d for d, root in want.items()) > 450
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, size=4).collect()}
    assert [d for d in texts if got[d] != want[d]] == []
