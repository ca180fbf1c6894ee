"""Packing of token sequences into windows of several lengths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliotab.llm import bpe
from foliotab.llm.token_counts import default_vocabulary
from foliotab.llm.worker import kept

TIERS = (1024, 512, 256, 128, 64)
BLOCK_TOKENS = 4_000_000
STEP_TOKENS = 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of these token counts: (window length, [(document, start, length), ...]).

    A document is first cut into full windows of the longest tier. Its rest is routed to the shortest tier that holds
    it. Tiers are packed from the longest: the longest rest opens a window, and its gap is filled from the shortest rests,
    whole while they fit and cut where the gap ends. So every window but the last is full. The last one is cut into
    full windows of the shorter tiers; only what is shorter than the shortest tier is left over, once per call.
    """
    longest, rests = tiers[0], []
    for i, n in enumerate(lengths):
        for start in range(0, n - n % longest, longest):
            yield longest, [(i, start, longest)]
        if n % longest:
            rests.append((n % longest, i))
    rests.sort(reverse=True)
    at, end = 0, len(rests) - 1
    taken = 0  # tokens already cut from the front of rests[end]
    while at <= end:
        n, i = rests[at]
        used = taken if at == end else 0
        begin, n = lengths[i] - n + used, n - used
        window = next(t for t in reversed(tiers) if t >= n)
        pieces, gap = [(i, begin, n)], window - n
        at += 1
        while gap and at <= end:
            m, j = rests[end]
            m -= taken
            take = min(gap, m)
            pieces.append((j, lengths[j] - m, take))
            gap -= take
            taken += take
            if take == m:
                end, taken = end - 1, 0
        if not gap:
            yield window, pieces
        else:
            yield from _cut(pieces, tiers)


def _cut(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """A window that could not be filled, as full windows of shorter tiers and one remainder."""
    left = sum(p[2] for p in pieces)
    while left:
        window = next((t for t in tiers if t <= left), left)
        room, now, later = window, [], []
        for i, start, n in pieces:
            take = min(room, n)
            if take:
                now.append((i, start, take))
            if n > take:
                later.append((i, start + take, n - take))
            room -= take
        yield window, now
        pieces, left = later, left - window


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents in windows of at most ``tiers[0]`` tokens, one row per piece.

    Each task packs the documents it reads, in blocks of ``block_tokens`` tokens, so there is no shuffle and no hot key,
    and memory is bounded by a block and one document. A block leaves at most one window that is not full; that one
    is shorter than the shortest tier. ``window`` is the length of the window (0 for such a remainder), ``step_group``
    names equal-shaped windows that make one training step: the windows of a tier in a block are dealt in turn over as
    many groups as hold ``step_tokens`` each, so groups of a block differ by one window at most.

    Every document ends with ``end_id``, so a null or empty text is one token. Ids may be null or repeated: each row is a
    document of its own. ``ids_crc32`` is taken over little-endian 32-bit ids. ``sequence_id`` holds the task in its upper
    bits; the rows of one run are consistent as no shuffle follows.
    """
    path = vocabulary or default_vocabulary()
    whole = bpe.Vocabulary.of(path).whole_tokens()

    def little(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.Vocabulary.of(path)
        memo = kept(("ids", path), lambda: bpe.Memo(own, {t: i.to_bytes(4, "little") for t, i in whole.items()}, lambda piece: little(own.merge(piece.encode())), b"".join))
        library = lambda part: little(own.library.encode(part, add_special_tokens=False).ids)
        end = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 33
        state = {"sequence": 0, "group": 0}
        block, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memo.encode(text.as_py() or "", lambda i: i.to_bytes(4, "little"), library) + end
                block.append((doc, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from flush(block, base, state)
                    block, size = [], 0
        if block:
            yield from flush(block, base, state)

    def flush(block, base, state) -> Iterator[pa.RecordBatch]:
        windows = list(plan_windows([len(ids) // 4 for _, ids in block], tiers))
        per_tier: dict[int, int] = {}
        for window, _ in windows:
            per_tier[window] = per_tier.get(window, 0) + 1
        groups, first = {}, state["group"]
        for window, n in sorted(per_tier.items()):
            groups[window] = (first, max(1, round(n * window / step_tokens)))
            first += groups[window][1]
        state["group"] = first
        seen: dict[int, int] = {}
        rows = []
        for window, pieces in windows:
            turn = seen[window] = seen.get(window, -1) + 1
            at, number = groups[window]
            offset = 0
            for i, start, n in pieces:
                doc, ids = block[i]
                rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + state["sequence"], offset, window if window in tiers else 0, base + at + turn % number))
                offset += n
            state["sequence"] += 1
        for at in range(0, len(rows), 50_000):
            part = list(zip(*rows[at : at + 50_000]))
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names=names)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)
