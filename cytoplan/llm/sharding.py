"""Placement of documents on shards by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 6553
#: Most slots of a table: it is broadcast, so its size has a bound of its own (a few bytes a slot).
MOST_SLOTS = 1_000_003


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Shards take turns; in its turn a shard claims the next free slot of its preference order.

    Shard s prefers (offset + j * skip) mod slots for j = 0, 1, ..., both from a digest of its name, so a changed list of shards
    moves few slots. The number of slots is prime, else an order would miss slots; at least one slot for each shard.
    """
    if slots > MOST_SLOTS or slots < len(shards) or not shards or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, at least the number of shards and within MOST_SLOTS")
    if len(set(shards)) < len(shards):
        raise ValueError("shards must have different names")
    halves = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(x[:12], 16) % slots for x in halves]
    skip = [int(x[12:24], 16) % (slots - 1) + 1 for x in halves]
    table, filled = [-1] * slots, 0
    while True:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its digest modulo the table's size; null keys share the slot of the empty key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard (its number). The table is bounded by MOST_SLOTS and broadcast, so a row costs one lookup and no shuffle.

    Rows of one key go to one shard, repeated rows too; a null key is placed like an empty one; empty tables give an empty result.
    Columns named slot or shard are replaced.
    """
    table = lookup_table(shards or [f"shard-{i:05d}" for i in range(SHARDS)], slots)
    spark = docs.sparkSession
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "shard"))
    rows = rows.select("slot", F.col("shard").cast("int").alias("shard"))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(rows), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle_sql() -> str:
    """The placement in DuckDB's SQL: the table is filled turn by turn in a recursive query."""
    n, m = SHARDS, SLOTS
    return f"""
WITH RECURSIVE p AS (SELECT i AS s, ('0x' || substr(md5(printf('shard-%05d', i)), 1, 12))::BIGINT % {m} AS start,
    ('0x' || substr(md5(printf('shard-%05d', i)), 13, 12))::BIGINT % {m - 1} + 1 AS skip FROM range({n}) r(i)),
fill(k, owner) AS (
  SELECT 0::BIGINT, list_transform(range({m}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT k + 1, (SELECT list_transform(f.owner, lambda x, i: CASE WHEN i = c.claim THEN p.s ELSE x END)
     FROM (SELECT list_filter(list_transform(range({m}), lambda j: 1 + (p.start + j * p.skip) % {m}), lambda t: f.owner[t] < 0)[1] AS claim) c)
  FROM fill f JOIN p ON p.s = f.k % {n} WHERE k < {m}),
slots AS (SELECT unnest(owner) AS shard, generate_subscripts(owner, 1) - 1 AS slot FROM fill WHERE k = {m})
SELECT d.doc_id, d.slot::INTEGER AS slot, s.shard::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {m} AS slot FROM documents) d JOIN slots s USING (slot)
"""
