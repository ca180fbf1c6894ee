"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliotab.llm import bpe
from foliotab.llm.worker import kept


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of each whole text, as the tokenizer library counts them without begin and end tokens.

    The driver proves once which vocabulary strings are one token by themselves; a task splits its texts into
    pre-tokens, counts those directly, and merges only the rest (each distinct one once per worker, within a bounded
    memo). A special string inside a text is one token, as is the library's default. Null and empty texts have 0 tokens.
    """
    path = vocabulary or default_vocabulary()
    whole = list(bpe.Vocabulary.of(path).whole_tokens())

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = bpe.Vocabulary.of(path)
        memo = kept(("counts", path), lambda: bpe.Memo(own, dict.fromkeys(whole, 1), lambda piece: len(own.merge(piece.encode())), sum))
        library = lambda part: len(own.library.encode(part, add_special_tokens=False).ids)
        for texts in batches:
            yield pa.array([memo.encode(t.as_py() or "", lambda _: 1, library) for t in texts], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Rows with a null id and repeated rows are kept as they are; null texts count as empty. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
