"""Sharding by a permutation-filled look-up table.

The table has a prime number of slots. Every shard has a permutation of the slots, fixed by two hashes of its name, and
the shards take turns claiming the first slot of their permutation that is still free, until none is. Shares differ by
one slot at most, and when a shard leaves or joins most slots keep their owner. The table has SLOTS rows whatever the
data, so it is broadcast and a document is placed by one look-up of its key's hash; nothing is shuffled.

The key is the id by default; a null key hashes as an empty string, equal keys go to one shard, so repeated rows stay
together. A hot source is spread because its ids are. Columns named slot and shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import md5_long

#: A prime, at least 100 slots for each of up to 80 shards.
SLOTS = 8191


def claims(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (index of the shard) of every slot, by turns."""
    if not shards or len(shards) != len(set(shards)) or len(shards) > slots:
        raise ValueError("shards are distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is prime")
    start, step = [], []
    for name in shards:
        h = hashlib.md5(name.encode()).hexdigest()
        start.append(int(h[:15], 16) % slots)
        step.append(int(h[15:30], 16) % (slots - 1) + 1)
    owner, tried, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            slot = (start[k] + tried[k] * step[k]) % slots
            while owner[slot] >= 0:
                tried[k] += 1
                slot = (start[k] + tried[k] * step[k]) % slots
            owner[slot] = k
            tried[k] += 1
            free -= 1
    return owner


def slot_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for every slot."""
    owners = F.split(F.lit(",".join(map(str, claims(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "k")).select(
        F.col("slot").cast("long").alias("slot"), F.get(names, F.col("k").cast("int")).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(md5_long(key), F.lit(slots))


def placed(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """`docs` with slot and shard."""
    table = F.broadcast(slot_table(docs.sparkSession, shards, slots))  # bounded: one row per slot
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.select(*rest, slot_of(F.col(key), slots).alias("slot")).join(table, "slot").select(*rest, "slot", "shard")


def write_shards(docs: DataFrame, shards: list[str], path: str, key: str = "doc_id", slots: int = SLOTS) -> None:
    """One folder per shard; the rows of a shard are dealt to tasks by slot, so no shard is one task."""
    placed(docs, shards, key, slots).repartition("slot").write.partitionBy("shard").parquet(path)
