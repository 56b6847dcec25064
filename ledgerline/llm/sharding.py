"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: slot (offset + j * skip) mod
size, with offset and skip from its name.  The shards take turns; each claims its next free slot, until the
table is full.  All shares differ by at most one slot, and taking a shard away moves few other slots.  A
row's slot is a hash of its key; the table is broadcast (its size is a parameter), so placing a row is one
lookup, and no row moves.

The hashes are the first 15 hex digits of MD5.  Defined cases: a null key is placed as the empty text; equal
keys are always placed together; an empty table gives no rows.  The new columns replace columns of the same
names; all others stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import by_position

TABLE_SIZE = 2039       # prime, over 100 slots for each of 16 shards
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _preferences(shard: str, size: int):
    offset, skip = _hash(shard + "#offset") % size, _hash(shard + "#skip") % (size - 1) + 1
    return ((offset + j * skip) % size for j in range(size))


def lookup_table(shards=SHARDS, size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be different names, at least one and at most one per slot")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    order = [_preferences(s, size) for s in shards]
    table: list[str | None] = [None] * size
    for turn in range(size):
        no = turn % len(shards)
        slot = next(x for x in order[no] if table[x] is None)
        table[slot] = shards[no]
    return table


def _frame(spark: SparkSession, table: list[str]) -> DataFrame:
    names = sorted(set(table))
    numbers = ",".join(str(names.index(s)) for s in table)
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "n"))
    return slots.select(F.col("slot").cast("long"), F.element_at(F.array(*map(F.lit, names)), F.col("n").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def assign_shards(df: DataFrame, key_col: str = "doc_id", shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, which replace columns of these names (in any case)."""
    table = F.broadcast(_frame(df.sparkSession, lookup_table(shards, size)).toDF("slot", "shard"))
    plain = by_position(df)
    placed = plain.withColumn("at", slot_of(F.col(f"c{df.columns.index(key_col)}"), size))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in ("slot", "shard")]
    return placed.join(table, F.col("at") == F.col("slot")).select(*own, "slot", "shard")


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", shards=SHARDS, size: int = TABLE_SIZE) -> None:
    """Write the rows as one folder per shard; every task adds its rows to each, so no shard is one task."""
    assign_shards(df, key_col, shards, size).write.partitionBy("shard").mode("overwrite").parquet(path)
