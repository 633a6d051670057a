"""Consistent sharding through a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size; the shards take turns claiming their next
free slot until the table is full. A row's key is hashed to a slot, so placing it is one probe of a broadcast table whose
size is fixed by its prime, whatever the number of rows. Adding or removing a shard moves few slots of the others.

Defined cases: a null in a key column counts as a value of its own, distinct from any text; an empty or very long key is
hashed whole, like any other; rows with equal keys share a shard; an empty table gives an empty result; columns of the input stay as they are, and clashing result names get a
trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.shared import col, fresh

#: Slots for each shard; of more than MOST_SLOTS in all (some 40 MB in memory, broadcast) as many as that, but two a shard.
SLOTS_A_SHARD, MOST_SLOTS, LEAST_SLOTS_A_SHARD = 100, 1 << 20, 2


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(n_shards: int) -> int:
    """The least prime with SLOTS_A_SHARD slots for each shard: no shard has over about 1 % more than another.

    From 10,485 shards on the table grows no further and its slots are shared out; beyond half a million it follows the
    list of shards, which the caller holds anyway.
    """
    n = max(n_shards, 1)
    return next_prime(max(n * LEAST_SLOTS_A_SHARD, min(n * SLOTS_A_SHARD, MOST_SLOTS)))


def _number(seed: str, name: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int) -> list[int]:
    """The index of the shard that holds each slot."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or next_prime(size) != size:
        raise ValueError(f"the table needs a prime size, {len(shards)} at least")
    offsets = [_number("offset", s) % size for s in shards]
    skips = [_number("skip", s) % (size - 1) + 1 for s in shards]
    turn, table, free = [0] * len(shards), [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[slot := (offsets[i] + turn[i] * skips[i]) % size] >= 0:
                turn[i] += 1
            table[slot], free = i, free - 1
            if not free:
                break
    return table


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table size."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("!")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long"), F.lit(size))


def table_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot long, shard int")


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int | None = None) -> DataFrame:
    """df with `slot` and `shard` (the index in shards); no shuffle."""
    size = size or table_size(len(shards))
    slot, shard = fresh(df, "slot", "shard")
    table = table_frame(df.sparkSession, shards, size).toDF(slot, shard)
    placed = df.withColumn(slot, slot_of([col(k) for k in keys], size))
    return placed.join(F.broadcast(table), slot, "left").select(*[col(c) for c in df.columns], col(slot), col(shard))


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, splits: int = 1) -> None:
    """Write df as Parquet in one folder a shard; `splits` tasks write each, so that a large shard is no one task's."""
    placed = assign_shards(df, keys, shards)
    shard = placed.columns[-1]
    (salt,) = fresh(placed, "salt")
    spread = placed.withColumn(salt, F.pmod(F.xxhash64(*[col(k) for k in df.columns]), F.lit(splits)))
    spread.repartition(len(shards) * splits, shard, salt).drop(salt, placed.columns[-2]).write.partitionBy(shard).parquet(path)


def moved_slots(before: Sequence[str], after: Sequence[str], size: int) -> float:
    """The share of slots whose shard's name differs between two shard lists."""
    a, b = lookup_table(before, size), lookup_table(after, size)
    return sum(before[x] != after[y] for x, y in zip(a, b, strict=True)) / size
