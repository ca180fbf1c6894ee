"""Near-duplicate documents from bottom-k sketches of one hash function, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliotab.llm.links import KEY_BITS, linked_groups
from foliotab.llm.nodes import bitmap, marked, slot
from foliotab.llm.words import mix, shingle_sets
from foliotab.session import cut_lineage

SKETCH = 256
#: Texts whose full sets a worker holds at once.
SOME = 128
WEIGHTS = 1 << 16
#: Share of a sketch that two linked sketches hold in common; four standard deviations below what the bound implies.
COMMON = 0.70
#: Sign bits of 64 that two linked documents share where a set is larger than its sketch, and union-sketch estimate; both over
#: four standard deviations below. Signs are of full sets: sketches of sets of unlike size cover unlike ranges of values.
SIGNS = 47
SLACK = 0.15
#: Parity bits of a full set, and as many after folding for postings (four longs). Each value flips one bit, so two sets differ in
#: at least as many values as bits.
PARITY = 1024
FOLDED = 256
FOLDS = tuple(f"odd{i}" for i in range(FOLDED // 64))


def signs(values: np.ndarray) -> int:
    """64 sign bits: the values fall into 64 bins, the smallest of a bin gives its bit."""
    bins = (values >> np.uint64(7)) & np.uint64(63)
    lead = np.full(64, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(lead, bins, mix(values))
    bit = (lead >> np.uint64(17)) & np.uint64(1)
    bit[lead == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
    return int(np.packbits(bit.astype(np.uint8)).view(np.int64)[0])


def parity(values: np.ndarray) -> bytes:
    """``PARITY`` bits: how many values of the set fall on each, modulo 2."""
    at = (mix(values + np.uint64(1)) & np.uint64(PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def folded(raw: bytes) -> np.ndarray:
    """Parity bits of ``FOLDED`` places, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.int64).reshape(-1, FOLDED // 64))


def prefix_length(n: int, sketch: int, threshold: float) -> int:
    """How many of the rarest of ``n`` retained values must meet a linked document's."""
    least = int(np.ceil(threshold * n - 1e-9)) if n <= threshold * sketch else int(COMMON * n)
    return n - least + 1


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, sketch: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where the Jaccard similarity of their ``size``-word shingle sets is at least ``threshold``;
    ``component_id`` is the smallest id reachable over links. Documents without words are linked with nothing. A null id
    takes no part (null component, kept). Rows of one id count as one document that has all their texts' links.

    Equal sets are made one class first. Each class keeps the ``sketch`` smallest values of its set, and posts the rarest
    of them, as many as any linked document must share one of; rarity comes from counts of values by their last 16 bits.
    Lists are compared by ``linked_groups``; pairs whose sizes, prefix positions, parity bits or sign bits (of the full sets) rule a
    link out go first, then, before any set is moved, those whose unfolded parity bits do, then those whose union sketch
    estimates less than the threshold by ``SLACK``, and full sets decide. Parity bits lose nothing. Below the
    sketch size sketches are the full sets and signs are not asked, so nothing can be lost; above, the sign test loses a pair
    at the threshold of 0.8 with a probability of about 4e-5, one at 0.85 7e-7 (binomial), and the sketch's margins
    are four standard deviations or more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = cut_lineage(rows.mapInArrow(_signatures(size, sketch), "doc_id long, n int, hi long, lo long, sketch binary, signs long, odd binary"))
    real = found.where("n > 0 and doc_id is not null")
    classes = cut_lineage(real.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node")))
    # Rows that no copy's bit marks are their class's first; only the few others need a look-up.
    named = real.withColumnRenamed("doc_id", "node").select("hi", "lo", "n", "node", "sketch", "signs", "odd", slot(F.col("node")).alias("slot"))
    copies = real.select("hi", "lo", "n", F.col("doc_id").alias("node")).join(classes, ["hi", "lo", "n", "node"], "left_anti")
    marks = bitmap(copies, slot(F.col("node")))
    shape = "hi long, lo long, n int, node long, sketch binary, signs long, odd binary"
    looked_up = named.mapInArrow(_by_mark(marks, True), shape).join(classes, ["hi", "lo", "n", "node"], "left_semi")
    looked_up = cut_lineage(looked_up.dropDuplicates(["hi", "lo", "n", "node"]))
    reps = named.mapInArrow(_by_mark(marks, False), shape).unionByName(looked_up).select("node", "n", "sketch", "signs", "odd")

    weights = np.zeros(WEIGHTS, np.int64)
    for row in reps.select("sketch").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        weights[row["bucket"]] = row["n"]  # at most WEIGHTS rows

    def postings(marks: bytes | None) -> DataFrame:
        if marks is None:
            return reps.mapInArrow(_postings(weights, sketch, threshold, None), "key long, prio long")
        return reps.mapInArrow(_postings(weights, sketch, threshold, marks), "key long, node long, prio long, n int, upto int, ratio int, signs long, " + ", ".join(f"{c} long" for c in FOLDS))

    unlike = (1 - threshold) / (1 + threshold)  # of both sizes, as many values at most differ

    def near(mine, other):
        low, high = F.least(mine("n"), other("n")), F.greatest(mine("n"), other("n"))
        fits = (mine("n") <= other("upto")) & (other("n") <= mine("upto")) & (1000 * low <= F.least(mine("ratio"), other("ratio")) * high)
        apart = sum((F.bit_count(mine(c).bitwiseXOR(other(c))) for c in FOLDS), F.lit(0))
        fits = fits & (apart <= F.lit(unlike) * (low + high) + 1e-6)
        return fits & ((high <= sketch) | (F.bit_count(mine("signs").bitwiseXOR(other("signs"))) <= 64 - SIGNS))

    full: list[DataFrame] = []  # sets of the nodes asked for so far

    def verify(pairs: DataFrame) -> DataFrame:
        asked = bitmap(_ends(pairs), slot(F.col("node")))
        bits = found.select(F.col("doc_id").alias("node"), "n", "odd", slot(F.col("doc_id")).alias("slot")).where("n > 0 and node is not null")
        bits = cut_lineage(bits.mapInArrow(_by_mark(asked, True), "node long, n int, odd binary").distinct())
        left, right = (bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
        pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "oa", "ob")
        pairs = cut_lineage(pairs.mapInArrow(_maybe(unlike), "a long, b long").distinct())
        ends = cut_lineage(_ends(pairs))
        wanted = ends
        for table in full:
            wanted = wanted.join(table, "node", "left_anti")
        wanted = cut_lineage(wanted) if full else ends
        if not full or not wanted.isEmpty():
            maybe = rows.withColumn("slot", slot(F.col("doc_id"))).mapInArrow(_sets(size, bitmap(wanted, slot(F.col("node")))), "node long, values binary")
            full.append(cut_lineage(maybe.join(wanted, "node", "left_semi").dropDuplicates(["node", "values"])))
        sets = reduce(DataFrame.unionByName, full).withColumn("slot", slot(F.col("node")))
        sets = sets.mapInArrow(_by_mark(bitmap(ends, slot(F.col("node"))), True), "node long, values binary")
        left, right = sets.select(F.col("node").alias("a"), F.col("values").alias("va")), sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_alike(threshold, sketch), "a long, b long").distinct()

    roots = linked_groups(postings, near, verify, same=("n", "signs", *FOLDS))
    placed = classes.join(roots, "node", "left").select("hi", "lo", "n", F.coalesce("root", "node").alias("component"))
    least = found.join(placed, ["hi", "lo", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return least.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _signatures(size: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, low, bits, odd = [], [], [], [], [], []
            for values in shingle_sets(batch.column(1), size):
                n.append(len(values))
                hi.append(int(np.add.reduce(values, dtype=np.uint64).view(np.int64)))
                lo.append(int(np.bitwise_xor.reduce(mix(values), initial=np.uint64(0)).view(np.int64)))
                low.append(values[:sketch].tobytes())
                bits.append(signs(values))
                odd.append(parity(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(low, pa.binary()), pa.array(bits, pa.int64()), pa.array(odd, pa.binary())], names=["doc_id", "n", "hi", "lo", "sketch", "signs", "odd"])

    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(WEIGHTS, np.int64)
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        counts += np.bincount((values & np.uint64(WEIGHTS - 1)).astype(np.int64), minlength=WEIGHTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _maybe(unlike: float):
    """Pairs whose sets' parity bits differ in no more places than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in (4, 5))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart <= unlike * (na.astype(np.int64) + nb) + 1e-6))

    return run


def _by_mark(marks: bytes, wanted: bool):
    """Rows whose last column is the place of a set bit (or of one not set), without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.num_columns - 1
            hit = marked(marks, batch.column(slots).to_numpy())
            yield batch.filter(pa.array(hit == wanted)).select(list(range(slots)))

    return run


def _postings(weights: np.ndarray, sketch: int, threshold: float, marks: bytes | None):
    """The rarest values of each sketch. ``prio`` puts documents first whose values are common: they link most others.

    A value at place i of the order leaves n - i values in common at most. Where the sketch is the full set, that bounds the
    other set's size (``upto``). Else it bounds how like the sizes can be (``ratio``, in thousandths): sets of sizes in
    ratio r that are linked have threshold / (1 + threshold) * (1 + r) of the smaller sketch range in common, less chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = 4.5 * np.sqrt(sketch * threshold * (1 - threshold))
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(2 if marks is None else 7 + len(FOLDS))]
            for node, n, raw, sign, odd in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(raw, np.uint64)
                weight = weights[(values & np.uint64(WEIGHTS - 1)).astype(np.int64)]
                take = prefix_length(len(values), sketch, threshold)
                order = np.lexsort((values, weight))[:take]
                central = int(np.log2(weight + 1.0).mean() * (1 << 14))
                place = int(mix(np.array([node], np.int64).view(np.uint64))[0] >> np.uint64(24))
                whole = n <= threshold * sketch
                prio = ((1 << 20) - central << 40) | place
                keys, left = values[order].view(np.int64), len(values) - np.arange(take)
                if marks is None:
                    columns = (keys, np.full(take, prio))
                else:
                    hit = marked(marks, keys & (KEY_BITS - 1))
                    keys, left = keys[hit], left[hit]
                    if whole:
                        upto, ratio = np.floor((1 + threshold) / threshold * left - n + 1e-9), np.full(len(keys), 1000)
                    else:
                        upto = np.full(len(keys), np.floor(n / threshold + 1e-9))
                        ratio = np.clip(np.ceil(1000 * ((left + chance) / (threshold / (1 + threshold) * len(values)) - 1)), 0, 1000)
                    columns = (keys, np.full(len(keys), node), np.full(len(keys), prio), np.full(len(keys), n), np.minimum(upto, 2**31 - 1), ratio, np.full(len(keys), sign), *(np.full(len(keys), x) for x in folded(odd)))
                for column, x in zip(out, columns):
                    column.append(x)
            if out[0]:
                kinds = {"key": pa.int64(), "prio": pa.int64()} if marks is None else {"key": pa.int64(), "node": pa.int64(), "prio": pa.int64(), "n": pa.int32(), "upto": pa.int32(), "ratio": pa.int32(), "signs": pa.int64(), **dict.fromkeys(FOLDS, pa.int64())}
                arrays = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(out, kinds.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return run


def _sets(size: int, marks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(marks, batch.column(2).to_numpy())))
            for at in range(0, len(batch), SOME):
                part = batch.slice(at, SOME)
                values = [v.tobytes() for v in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], names=["node", "values"])
            pa.default_memory_pool().release_unused()

    return run


def _alike(threshold: float, sketch: int):
    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
            union = np.union1d(a[:sketch], b[:sketch])[:sketch]
            both = np.isin(union, a[:sketch], assume_unique=True) & np.isin(union, b[:sketch], assume_unique=True)
            if both.mean() < threshold - SLACK:
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common >= threshold * (len(a) + len(b) - common) - 1e-9:
                keep.append(i)
        return batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = linked(batch)
            del batch  # both sets of each pair, before the next ones come
            pa.default_memory_pool().release_unused()
            yield found

    return run
