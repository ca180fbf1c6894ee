"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, single spaces."""
    return " ".join(text.lower().split())


def pieces(n: int, errors: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """``errors`` + 1 pieces of an item of ``n`` characters: (start, end, larger parts around it with their budgets).

    An item within its budget has a half within half of it, less one: budgets (e - 1) split over the halves. So some
    piece is untouched, and each part around it is within the part's own budget. The parts come from small to large.
    """
    out = []

    def split(start: int, end: int, e: int, around: list[tuple[int, int, int]]) -> None:
        if e == 0:
            out.append((start, end, around[::-1]))
            return
        left = (e - 1) // 2
        middle = start + (end - start) * (left + 1) // (e + 1)
        split(start, middle, left, [*around, (start, end, e)])
        split(middle, end, e - 1 - left, [*around, (start, end, e)])

    split(0, n, errors, [])
    return out


def best_end(masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance between a pattern and any part of ``text``, and where the first such part ends.

    Bit-parallel column of the edit matrix; ``masks`` has the pattern's places of each character.
    """
    top, full = 1 << (n - 1), (1 << n) - 1
    up, down, score, best, end = full, 0, n, n, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        flat = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = right_up << 1 & full
        up = (right_down << 1 & full) | (full & ~(flat | right_up))
        down = right_up & flat
        if score < best:
            best, end = score, i + 1
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, distance, start, length, budget): each test item found in a document, where it is nearest.

    Texts are compared in lower case with single blanks. An item of n characters may differ by ``floor(rate * n)`` edits
    from a part of the document. ``start`` and ``length`` (characters of the normalised text) bound that part's
    surroundings, ``distance`` is its edit distance. Items under ``min_chars`` characters (null and empty ones too) are too
    short to prove anything and are not searched. Documents with null or empty texts have no hits; null ids are kept.
    Items of equal text all report; repeated rows report once each.

    Each item is cut into budget + 1 pieces, all pieces are looked for in one pass, and around every hit the item is
    verified by bit-parallel edit distance, from its smallest part up. The benchmark goes to the tasks in blocks of at
    most ``block_chars`` characters, each of which is searched in all documents; the documents are never shuffled.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in _blocks(items, block_chars):
        part = rows.mapInArrow(_search(block, rate, min_chars), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.mapInArrow(_search([], rate, min_chars), SCHEMA)


SCHEMA = "doc_id long, item_id long, distance int, start long, length int, budget int"


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():  # one partition of test items at a time
        if block and size + len(row["body"]) > most:
            yield block
            block, size = [], 0
        block.append((row["item"], row["body"]))
        size += len(row["body"])
    if block:
        yield block


class Finder:
    """The items of one block, ready to search texts. Built once in each task."""

    def __init__(self, block: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items: dict[str, list[int]] = {}
        for item, body in block:
            form = normalise(body)
            if len(form) >= min_chars:
                self.items.setdefault(form, []).append(item)
        self.forms = list(self.items)
        self.budgets = [int(rate * len(form)) for form in self.forms]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        places: dict[str, list] = {}
        for i, form in enumerate(self.forms):
            for start, end, around in pieces(len(form), self.budgets[i]):
                places.setdefault(form[start:end], []).append((i, end, around))
        self.finder = ahocorasick.Automaton()
        for piece, where in places.items():
            self.finder.add_word(piece, where)
        if places:
            self.finder.make_automaton()

    def nearest(self, i: int, start: int, stop: int, window: str) -> tuple[int, int]:
        key = (i, start, stop)
        if key not in self.masks:
            self.masks[key] = masks_of(self.forms[i][start:stop])
        return best_end(self.masks[key], stop - start, window)

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item's place in ``forms``, distance, start) for each verified piece of the normalised text."""
        if not self.forms:
            return
        done: set[tuple[int, int]] = set()
        for last, places in self.finder.iter(text):
            for i, end, around in places:
                origin = last + 1 - end  # of the item, were there no edits before the piece
                if (i, origin) in done:
                    continue
                for start, stop, errors in around:
                    window = text[max(0, origin + start - errors) : max(0, origin + stop + errors)]
                    if self.nearest(i, start, stop, window)[0] > errors:
                        break
                else:
                    done.add((i, origin))
                    n, budget = len(self.forms[i]), self.budgets[i]
                    begin = max(0, origin - budget)
                    distance, stop = self.nearest(i, 0, n, text[begin : origin + n + budget])
                    if distance <= budget:
                        yield i, distance, max(0, begin + stop - n)


def _search(block: list[tuple[int, str]], rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(block, rate, min_chars)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                best: dict[int, tuple[int, int]] = {}
                for i, distance, start in find.hits(normalise(text.as_py() or "")):
                    best[i] = min(best.get(i, (distance, start)), (distance, start))
                out.extend((doc, item, distance, start, len(find.forms[i]), find.budgets[i]) for i, (distance, start) in best.items() for item in find.items[find.forms[i]])
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has a test item in it, by the rules of ``benchmark_hits``; no shuffle."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    for block in _blocks(items, block_chars):
        docs = docs.where(~_contaminated(block, rate, min_chars)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _contaminated(block: list[tuple[int, str]], rate: float, min_chars: int):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = Finder(block, rate, min_chars)
        for texts in batches:
            yield pa.array([next(find.hits(normalise(t.as_py())), None) is not None for t in texts], pa.bool_())

    return run
