"""Placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard. ``slots`` must be prime and at least the number of shards.

    Every shard has an order of preference over all slots (an offset and a stride from hashes of its name, which visit
    every slot of a prime-sized table). In turns each shard claims the first slot of its order that is still free.
    """
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, no less than the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names that differ")
    at = [_number(f"offset:{name}") % slots for name in shards]
    stride = [_number(f"stride:{name}") % (slots - 1) + 1 for name in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the number of slots; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string); columns of those names are replaced.

    Rows of one key share a shard, a null key goes where an empty one goes. The table has ``slots`` rows whatever the size
    of ``df`` and is broadcast, so placement is one lookup a row, without a shuffle. A shard more or less moves about
    its own share of keys and little else.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]
