"""Language identification as a mixture of languages, fitted per document by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliotab.llm.words import mix, slices

BUCKETS = 1 << 17
WINDOW = 40
ROUNDS = 8
SMOOTH = 0.5


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, everything that is no letter made one blank, and their offsets.

    Each text has a blank of its own before and after it, so that no sequence reaches into another text.
    """
    low = pc.utf8_lower(pc.fill_null(column, ""))
    spaced = pc.replace_substring_regex(low, r"\PL+", " ")
    raw = "".join(f" {text} " for text in spaced.to_pylist())
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(sizes + 2)])


def grams(points: np.ndarray) -> np.ndarray:
    """Bucket of the three code points that start at each place (the last two places repeat the end)."""
    p = points.astype(np.uint64)
    p = np.concatenate([p, p[-1:], p[-1:]]) if len(p) else p
    n = len(points)
    h = p[:n] | p[1 : n + 1] << np.uint64(21) | p[2 : n + 2] << np.uint64(42)
    return (mix(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, offsets) of slices of the column."""
    sizes = pc.binary_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, to in slices(np.concatenate([[0], np.cumsum(sizes)]), 2 << 20):
        points, offsets = letters(column.slice(at, to - at))
        yield at, points, offsets


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of their three-letter sequences (buckets by languages).

    Counts cover all rows of ``labelled`` with a language; a task sends one row per bucket and language that it met, and
    the driver receives ``BUCKETS`` rows a language at most.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counted["lang"]))
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    for j, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        table[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(0, keepdims=True)).astype(np.float32) if langs else table.astype(np.float32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, points, offsets in chunks(batch.column(0)):
            g = grams(points)
            keep = inside(points)
            names, index = np.unique(langs[at : at + len(offsets) - 1], return_inverse=True)
            owner = np.repeat(index, np.diff(offsets))[: len(g)]
            for j, name in enumerate(names):
                own = total.setdefault(str(name), np.zeros(BUCKETS, np.int64))
                own += np.bincount(g[(owner == j) & keep], minlength=BUCKETS)
    for name, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], names=["lang", "bucket", "n"])


def inside(points: np.ndarray) -> np.ndarray:
    """Places whose three code points hold a letter in the middle: the place is in the text of that letter."""
    letter = points != 32
    keep = np.zeros(len(points), bool)
    keep[: max(0, len(points) - 2)] = letter[1:-1]
    return keep


def mixtures(like: np.ndarray, heads: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each document and the number of languages chosen.

    ``like`` has the log-likelihood of each window of text under each language, ``heads`` the first window of each
    document. Expectation-maximisation finds the proportions under which the windows are likeliest; it is run for the
    best 1, 2, ... and up to all languages, and of these sets the one with the best likelihood less half the logarithm of the number of
    windows for each further language is chosen.
    """
    windows = np.diff(np.append(heads, len(like)))
    owner = np.repeat(np.arange(len(heads)), windows)
    peak = like.max(1, keepdims=True)
    scaled = np.exp(like - peak)
    base = np.add.reduceat(peak[:, 0].astype(np.float64), heads)

    def em(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            weight = scaled * share[owner]
            weight /= np.maximum(weight.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(weight, heads, axis=0) / windows[:, None]
        fit_ = np.log(np.maximum((scaled * share[owner]).sum(1), 1e-30))
        return share, base + np.add.reduceat(fit_.astype(np.float64), heads)

    n = like.shape[1]
    alone = np.add.reduceat(like.astype(np.float64), heads, axis=0)
    full, _ = em(np.full((len(heads), n), 1 / n, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    order[:, :] = np.take_along_axis(order, np.argsort(order != alone.argmax(1)[:, None], axis=1, kind="stable"), 1)
    best = np.zeros((len(heads), n), np.float32)
    best[np.arange(len(heads)), order[:, 0]] = 1
    score, chosen = alone.max(1), np.ones(len(heads), np.int64)
    for size in range(2, n + 1):
        start = np.zeros((len(heads), n), np.float32)
        np.put_along_axis(start, order[:, :size], 1 / size, axis=1)
        share, fit_ = em(start)
        fit_ = fit_ - (size - 1) * (0.5 * np.log(windows) + 1)
        better = fit_ > score
        best[better], score[better], chosen[better] = share[better], fit_[better], size
    return best, chosen


def predict(text: Column, langs: list[str], table: np.ndarray) -> Column:
    """struct(lang_pred, score, languages): the language of the largest share, that share, and all languages chosen with
    their shares. A text that is null or has no letter is ``und`` with score 0; so is every text if no language was learned.
    """

    @F.arrow_udf("lang_pred string, score double, languages map<string,double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names: list[str] = ["und"] * len(texts)
            scores = np.zeros(len(texts))
            sets: list[list[tuple[str, float]]] = [[] for _ in range(len(texts))]
            for at, points, offsets in chunks(texts) if langs else ():
                keep = np.flatnonzero(inside(points))
                if not len(keep):
                    continue
                owner = np.searchsorted(offsets, keep, "right") - 1
                place = keep - offsets[owner]
                cut = np.ones(len(keep), bool)
                cut[1:] = (owner[1:] != owner[:-1]) | (place[1:] // WINDOW != place[:-1] // WINDOW)
                starts = np.flatnonzero(cut)
                like = np.add.reduceat(table[grams(points)[keep]], starts, axis=0)
                docs, heads = np.unique(owner[starts], return_index=True)
                share, _ = mixtures(like, heads)
                top = share.argmax(1)
                for i, j, p in zip((at + docs).tolist(), top.tolist(), share):
                    names[i], scores[i] = langs[j], min(1.0, float(p[j]))
                    sets[i] = [(langs[x], float(p[x])) for x in np.flatnonzero(p > 0)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=["lang_pred", "score", "languages"])

    return run(text)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` (replaced if present); every row is judged by its text alone."""
    found = docs.withColumn("__lang", predict(F.col(text_col).cast("string"), langs, table))
    return found.withColumns({c: F.col(f"__lang.{c}") for c in ("lang_pred", "score", "languages")}).drop("__lang")
