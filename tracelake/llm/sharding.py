"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has a preference order over the slots of a table of prime size: from an offset on in
steps of a skip, both from a hash of its name. Shards take turns and each claims the first slot
of its order that is free, until none is. So slots divide evenly, and if a shard goes, few slots
of the others move. A key's slot is its hash modulo the table's size, and the table, whose size
is a parameter, is broadcast: placing a row is one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime, and over a hundred times the shards, so that shares differ by under one percent.
SLOTS = 65_537
#: A larger table is refused, as it is broadcast: 24 bytes a slot.
MOST_SLOTS = 4_194_304
SHARDS = tuple(f"shard-{k:03d}" for k in range(128))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position in shards of the one that claims it."""
    if not 0 < len(set(shards)) == len(shards) <= slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct, and slots a prime that is no smaller and not too large")
    claimed = [-1] * slots
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    left = slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while claimed[slot] >= 0:
                slot = (slot + skip[k]) % slots
            claimed[slot], at[k] = k, (slot + skip[k]) % slots
            left -= 1
            if not left:
                return claimed


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its hash modulo slots. A null key has the slot of an empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot (long) and shard, the name of the shard that key belongs to.

    Equal keys go to one shard, so repeated rows do too; a null key is placed like an empty text.
    Columns of rows named slot or shard are replaced. An empty table stays empty.
    """
    claimed = ",".join(map(str, lookup_table(shards, slots)))
    spread = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(claimed), ",")).alias("at", "k"))
    names = F.array(*map(F.lit, shards))
    lookup = spread.select(F.col("at").cast("long").alias("slot"), F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))
    keyed = rows.withColumn("slot", slot_of(F.col(key), slots)).drop("shard")
    return keyed.join(F.broadcast(lookup), "slot").select(*(c for c in keyed.columns if c != "slot"), "slot", "shard")


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def placed_sql(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for op9, with the table's contents written out."""
    claimed = ",".join(map(str, lookup_table(shards, slots)))
    return f"""
with t as (select string_split('{claimed}', ',') as claimed, [{", ".join(f"'{s}'" for s in shards)}] as names),
k as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) % {slots} as slot from documents)
select doc_id, slot, names[cast(claimed[slot + 1] as integer) + 1] as shard from k cross join t"""


QUERIES = {"op9_lookup_sharding": op9_lookup_sharding}
ORACLE = {"op9_lookup_sharding": placed_sql()}
