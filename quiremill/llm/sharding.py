"""Placement of files on shards by a permutation-filled lookup table, without Python on the data's way.

Every shard prefers the slots of a prime-sized table in an order of its own; the shards take turns claiming their next free
slot until the table is full, so shards differ by at most one slot, and adding or losing a shard moves few others. The
table has a fixed size and is broadcast: placing a row is one hash and one lookup, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard for every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names, all different")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MAX_SLOTS}")
    walks = []
    for name in shards:
        h = hashlib.sha256(name.encode("utf-8")).digest()
        walks.append([int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1])
    table, left = [-1] * slots, slots
    while left:
        for shard, walk in enumerate(walks):
            while table[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % slots
            table[walk[0]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(key, slots: int = SLOTS):
    """Slot of a key; null has a slot as well."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots).cast("long"))


def place(files: DataFrame, shards: list[str], key: str = "file_id", slots: int = SLOTS) -> DataFrame:
    """(key, slot long, shard string): the shard of every row of `files` by its `key` column, one row per row.

    Equal keys meet on one shard; null keys share one as well. Rows may repeat; other columns are not read.
    """
    table = lookup_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    text = ",".join(map(str, table))
    rows = files.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "n"))
    lookup = rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))
    placed = files.select(F.col(key).alias("_key"), slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(F.col("_key").alias(key), "slot", "shard")
