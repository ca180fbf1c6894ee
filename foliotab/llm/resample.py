"""Importance resampling towards a target set: hashed word-run counts of both sides, log-ratio gains, Gumbel draws."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliotab.functions.ordered import global_position
from foliotab.llm.words import slices, utf8
from foliotab.session import cut_lineage

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Between the texts of a batch; no word holds it.
SENTINEL = b"\x00"
#: Fixed value: words are runs of digits, small letters and everything beyond ASCII (in UTF-8: bytes from 0x80).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All texts in small letters (A-Z only) with a sentinel after each, and where each text starts."""
    n = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n)
    whole = np.full(len(data) + n, SENTINEL[0], np.uint8)
    keep = np.ones(len(whole), bool)
    keep[offsets[1:] + np.arange(n)] = False
    whole[keep] = data
    return whole.tobytes().lower(), starts


def features(text: bytes, starts: np.ndarray, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 1 to ``ngram`` words that lies in one document, and the words of each document.

    One pass of the pattern finds the words of all documents; a word's document is found by its place among ``starts``.
    A run is in one document if its first and last word are.
    """
    words, at = [], []
    for m in WORD.finditer(text):
        words.append(m.group())
        at.append(m.start())
    doc = np.searchsorted(starts, np.array(at, np.int64), "right") - 1
    sums = list(map(crc32, words))
    docs, places = [doc], [np.array(sums, np.int64) % buckets]
    for more in range(1, ngram):
        sums = [crc32(b" " + w, s) for w, s in zip(words[more:], sums)]
        inside = doc[: len(sums)] == doc[more:]
        docs.append(doc[: len(sums)][inside])
        places.append((np.array(sums, np.int64) % buckets)[inside])
    return np.concatenate(docs), np.concatenate(places), np.bincount(doc, minlength=len(starts))


def _sliced(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    data, offsets = utf8(column)
    for at, to in slices(offsets):
        part = offsets[at : to + 1]
        yield at, to, *joined(data[part[0] : part[-1]], part - part[0])


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts (null: none). A task sends one row a bucket; so does Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, text, starts in _sliced(batch.column(0)):
                total += np.bincount(features(text, starts, ngram, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the source, both smoothed by one."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(id, n_words, n_features, weight) of every row; ``weight`` is the sum of its features' gains."""
    kind = dict(docs.dtypes)[id_col]
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, text, starts in _sliced(batch.column(1)):
                doc, place, words = features(text, starts, ngram, buckets)
                weight = np.zeros(to - at, np.int64)
                np.add.at(weight, doc, gain[place])
                cols = [batch.column(0).slice(at, to - at), pa.array(words), pa.array(np.bincount(doc, minlength=to - at)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """A draw of the Gumbel distribution in thousandths, fixed by ``seed`` and the id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", ngram: int = NGRAM,
    buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score, rank; ``rank`` is 1, 2, ... for the ``percent`` of the rows with
    ``min_words`` words that score highest, null for all others.

    Features are runs of 1 to ``ngram`` words, hashed into ``buckets``. The score is the weight plus a Gumbel draw, so the
    highest scores are a sample without replacement in proportion to the importance weights. Counts cover all rows of both
    tables. Null and empty texts have no features, weight 0 and no rank. Repeated rows are rows of their own; ties go to
    the smaller id (a null id is the smallest), then to the larger weight and number of features. An empty target gives
    every bucket the smoothed share. Other columns are not read.

    Two passes over the texts; what is sorted holds numbers only. The draw sorts by range, so no task or driver holds the
    whole sample.
    """
    spark: SparkSession = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    scored = weighed(docs, gain, id_col, text_col, ngram)
    able = F.col("n_words") >= min_words
    scored = scored.withColumns({"score": F.col("weight") + gumbel(F.col(id_col), seed), "__able": able})
    scored = cut_lineage(scored.withColumns({"__first": F.when(able, 0).otherwise(1), "__last": F.negate("score")}))
    wanted = percent * scored.where("__able").count() // 100
    ties = scored.withColumns({"__w": F.negate("weight"), "__f": F.negate("n_features")})
    placed = global_position(ties, ["__first", "__last", id_col, "__w", "__f"], "__place")
    drawn = F.col("__able") & (F.col("__place") <= wanted)
    return placed.select(id_col, "n_features", "weight", "score", F.when(drawn, F.col("__place")).cast("long").alias("rank"))
