"""Near duplicates, fuzzy lines and groups of links against brute force."""

import random
import re

import numpy as np
import pytest
from edge_rows import ROWS, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliotab.llm import linedup, links, neardup, words


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def brute_groups(texts, size, threshold=0.8):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    ids = sorted(texts)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    return closure(ids, linked), sets


def edited(rng, base, edits):
    out = base[:]
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Groups of copies with a few to many edits, so that chains and pairs at the bound occur, and a shared passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for g in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.choice([6, 30, 120, 600]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            texts[len(texts)] = edited(rng, base, rng.randrange(0, max(2, len(base) // 18)))
    for n in range(25):
        texts[len(texts)] = passage + [f"u{n}x{i}" for i in range(rng.randrange(0, 12))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return {order[i]: " ".join(t).capitalize() for i, t in texts.items()}


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5), (3, 4)])
def test_near_duplicates(spark, seed, size):
    texts = corpus(seed)
    want, sets = brute_groups(texts, size)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for r in neardup.near_duplicates(docs, size=size).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_small_sketch(spark):
    """Sketches far smaller than the sets: estimates only choose candidates, full sets decide."""
    texts = corpus(4)
    want, _ = brute_groups(texts, 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, size=4, sketch=128).collect()}
    assert sum(got[d] != want[d] for d in texts) <= 1


def test_near_duplicate_edges(spark):
    rows = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"] and by_id[1]["kept"]
    assert by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == by_id[5]["n_shingles"] == 0
    assert all(by_id[i]["component_id"] == i and by_id[i]["kept"] for i in (3, 4, 5, 6))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_groups_of_links(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 2000 + i) for i in range(300)]
    pairs = chain + star + [(5, 5), (-3, 900), (900, -3)]
    want = closure({n for p in pairs for n in p if n != 5 or True}, pairs)
    got = {r["node"]: r["root"] for r in links.groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert links.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_link_between_components_is_lost(spark):
    """Lists where the hub is linked to nobody and only some pairs deep in the list are."""
    rng = random.Random(5)
    n = 300
    linked = {(min(p), max(p)) for p in (rng.sample(range(n), 2) for _ in range(200))}
    postings = spark.createDataFrame([(7, i, i) for i in range(n)], "key long, node long, prio long")
    truth = spark.createDataFrame(sorted(linked), "a long, b long")
    roots = links.linked_groups(lambda marks: postings if marks else postings.select("key", "prio"), lambda mine, other: F.lit(True), lambda pairs: pairs.join(truth, ["a", "b"]))
    want = closure({x for p in linked for x in p}, linked)
    assert {r["node"]: r["root"] for r in roots.collect()} == want


def test_word_fingerprints_follow_the_words():
    import pyarrow as pa

    texts = ["The cat\tsat", "", None, "the  cat sat ", "the cat sit", "x" * 200, "X" * 200, "a b a\x0bb"]
    data, offsets = words.utf8(pa.array(texts))
    h, before = words.word_hashes(data, offsets)
    per = [h[a:b].tolist() for a, b in zip(before[:-1], before[1:])]
    assert per[0] == per[3] and per[0][:2] == per[4][:2] and per[0][2] != per[4][2] and per[5] == per[6] and len(per[7]) == 3
    assert per[1] == per[2] == []


def normal(line):
    out = bytes(b for b in line.encode().translate(linedup.NORMAL) if b not in linedup.PUNCTUATION)
    return " ".join(out.decode().split(" ")).split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=90), st.text("ab c", max_size=90))
def test_edit_distance(a, b):
    assert linedup.edit_distance(a, b) == distance(a, b)


def brute_lines(docs, min_words=5):
    """Kept text per document by the operator's rules, every pair of lines compared."""
    forms, first = {}, {}
    for d in sorted(docs):
        for i, line in enumerate(docs[d].split("\n")):
            form = normal(line)
            if len(form) >= min_words:
                forms.setdefault(" ".join(form), (d, i))
    texts = list(forms)
    _, sims = fingerprints(texts)
    linked = []
    for i, a in enumerate(texts):
        for j in range(i):
            if bin(sims[i] ^ sims[j]).count("1") <= linedup.FLIPS and distance(a, texts[j]) <= 0.1 * max(len(a), len(texts[j])) + 1e-9:
                linked.append((i, j))
    root = closure(range(len(texts)), linked)
    for i, t in enumerate(texts):
        first[root[i]] = min(first.get(root[i], (forms[t], t)), (forms[t], t))
    out = {}
    for d in docs:
        kept = []
        for i, line in enumerate(docs[d].split("\n")):
            form = " ".join(normal(line))
            if len(form.split()) < min_words or ((d, i), form) == first[root[texts.index(form)]]:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def fingerprints(texts):
    import pyarrow as pa

    prints, sims = [], []
    for _, table in linedup.line_tables(pa.array(texts), True):
        prints.extend(table.prints.tolist()), sims.extend(table.sims.tolist())
    return prints, sims


def test_fuzzy_lines(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(300)) for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    docs = {}
    for d in range(40):
        out = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz!, ") + line[at + 1 :]
            out.append(rng.choice([line, line.upper(), line + "."]))
        docs[d] = "\n".join(out)
    want = brute_lines(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in linedup.fuzzy_lines(df).collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_lines"] - r["n_removed"] == (len(want[d].split("\n")) if want[d] else r["n_lines"] - r["n_removed"]) for d, r in got.items())
    assert sum(r["n_removed"] for r in got.values()) > 50


def test_line_keys_find_all_within_the_flips():
    """Of any two SimHashes within the flips at least one key agrees."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    flips = [sum(1 << int(k) for k in rng.choice(64, linedup.FLIPS, replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    assert np.any([x == y for x, y in zip(linedup.block_keys(a), linedup.block_keys(b))], axis=0).all()
    far = rng.integers(0, 2**64, 500, dtype=np.uint64)
    assert not np.any([x == y for x, y in zip(linedup.block_keys(a), linedup.block_keys(far))], axis=0).any()


def test_line_edges(spark):
    rows = linedup.fuzzy_lines(edge_docs(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["text"] == ROWS[0][1] and r["source"] == "a" for r in by_id[1])  # rows of one id keep it both
    assert by_id[2][0]["text"] == "" and by_id[2][0]["n_removed"] == 1
    assert by_id[3][0]["text"] is None and by_id[3][0]["n_lines"] is None
    assert {r["text"] for r in by_id[None]} == {ROWS[0][1], None}
    assert linedup.fuzzy_lines(empty_docs(spark)).count() == 0
