"""Placement of rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own. The shards take turns, each
claiming the first slot of its order that is still free, until all are taken: the shards' shares
differ by one slot at most, and when a shard comes or goes few other slots change hands. A row's
slot is a hash of its key; the table, of a fixed size, is broadcast.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards and slots of the production table; slots must be a prime of at least a hundred times the shards.
SHARDS, SLOTS = 48, 5003


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot. slots must be a prime, names must differ."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need different names")
    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        first, step = int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:]) % (slots - 1) + 1
        orders.append(iter([(first + k * step) % slots for k in range(slots)]))
    table, free = [-1] * slots, slots
    while free:
        for shard, order in enumerate(orders[: min(len(orders), free)]):
            table[next(slot for slot in order if table[slot] < 0)] = shard
            free -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key of any type: from the first 32 bits of the MD5 of its text, or of `null`."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots


def _free(rows: DataFrame, name: str) -> str:
    """name, with underscores after it until rows has no such column."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def place(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, prefix: str = "shard-") -> DataFrame:
    """rows with `slot` and `shard` after its own columns; where it has columns of these names, the new ones get underscores after theirs.

    Every row is placed, rows with equal keys on the same shard; give a key of many values, so that no shard gets the
    rows of a frequent value. A null key has a slot too. Nothing is shuffled. An empty table gives no rows.
    """
    names = [f"{prefix}{k}" for k in range(shards)]
    held = json.dumps(lookup_table(names, slots))
    table = rows.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(held), "array<int>")).alias("slot", "_shard")).select(F.col("slot").cast("long"), F.concat(F.lit(prefix), F.col("_shard").cast("string")).alias("shard"))
    at, owner = (_free(rows, name) for name in ("slot", "shard"))
    table = table.select(F.col("slot").alias(at), F.col("shard").alias(owner))
    return rows.withColumn(at, slot(F.col(f"`{key}`"), slots)).join(F.broadcast(table), at).select(*(F.col(f"`{c}`") for c in (*rows.columns, at, owner)))


def write(rows: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Write rows as Parquet with a folder a shard."""
    at, owner = _free(rows, "slot"), _free(rows, "shard")
    place(rows, key, shards, slots).drop(at).write.partitionBy(owner).parquet(path)


def oracle(shards: int = SHARDS, slots: int = SLOTS, prefix: str = "shard-") -> str:
    """The lookup in SQL, with the table filled anew: slots go round by round to whoever asks first."""
    taken: dict[int, int] = {}
    asks = {}
    for k in range(shards):
        digest = hashlib.md5(f"{prefix}{k}".encode()).hexdigest()
        asks[k] = (int(digest[:16], 16) % slots, int(digest[16:], 16) % (slots - 1) + 1, 0)
    while len(taken) < slots:
        for k, (first, step, n) in list(asks.items()):
            while len(taken) < slots:
                at, n = (first + n * step) % slots, n + 1
                if at not in taken:
                    taken[at] = k
                    break
            asks[k] = (first, step, n)
    held = ", ".join(f"({at}, '{prefix}{k}')" for at, k in sorted(taken.items()))
    return f"""
    WITH held(slot, shard) AS (VALUES {held}),
    keyed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) % {slots} AS slot FROM documents)
    SELECT doc_id, slot, shard FROM keyed JOIN held USING (slot)
    """
