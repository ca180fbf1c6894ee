"""Fixed-size bitmaps of wanted ids, so that a scan sends on only rows that may be wanted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def slot(value: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def bitmap(ids: DataFrame, at: Column, bits: int = BITS) -> bytes:
    """``bits`` bits, set at the places that the rows of ``ids`` have in ``at``; its size does not depend on the number of ids.

    With very many ids most bits are set, and the scan then sends on most rows; a join afterwards keeps results exact.
    """
    rows = ids.groupBy(F.bitmap_bucket_number(at + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")).collect()
    out = bytearray(max(bits // 8, 4096))
    for row in rows:
        begin = (row["part"] - 1) * 4096
        out[begin : begin + 4096] = row["bits"]
    return bytes(out)


def marked(marks: bytes, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (np.frombuffer(marks, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
