"""Sharding by fixed virtual slots: records hash into thousands of slots, bytes are summed per slot,
and a versioned slot-to-shard map decides where each slot lives. The map is a table in the shared
folder, one folder per version; rows are dealt by what is read back from it. Rebalancing edits the
newest version, writes the next one and moves whole slots; records are never hashed anew.

Only DataFrame functions touch the rows. The driver sees one row per slot (at most `n_slots`), never
one per record, so what it plans with has a fixed bound, and so has the map that is broadcast.

The law is `bytes`: shards are nearly equal in size. Records are hashed by their id, so a group of
equal texts spreads over the shards as other records do and can't outweigh the balance.

Defined results: a null text has 0 text bytes; repeated rows are kept, each with a position of its
own; a null id hashes like any other value; an empty table gives an empty result. Ties: of slots with
equal loads the one with the smaller number goes first, of shards with equal totals likewise.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import fresh_path

N_SLOTS = 4096


@dataclass
class SlotMap:
    """Which shard owns each virtual slot. `edit` gives the next version and leaves this one as it is."""

    shard_of: list[int]
    n_shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)

    def edit(self, moves: dict[int, int], n_shards: int) -> SlotMap:
        owners = [moves.get(s, k) for s, k in enumerate(self.shard_of)]
        return SlotMap(owners, n_shards, self.version + 1, sorted(moves))

    def grow(self, load: list[int]) -> SlotMap:
        """One more shard, filled with slots of the fullest shards until it holds its share."""
        n, target = self.n_shards + 1, sum(load) / (self.n_shards + 1)
        total = [0] * n
        owned: list[list[int]] = [[] for _ in range(n)]
        for slot, shard in enumerate(self.shard_of):
            total[shard] += load[slot]
            owned[shard].append(slot)
        for slots in owned:
            slots.sort(key=lambda s: (load[s], s))
        moves: dict[int, int] = {}
        while total[-1] < target:
            fullest = max(range(self.n_shards), key=lambda k: (total[k], -k))
            if not owned[fullest]:
                break
            slot = owned[fullest].pop()
            if total[-1] + load[slot] > target and load[slot] > 0 and total[-1] > 0:
                break
            moves[slot] = n - 1
            total[fullest] -= load[slot]
            total[-1] += load[slot]
        return self.edit(moves, n)

    def column(self, values: list[int], slot: Column) -> Column:
        """values[slot] as a Column, from one literal of n_slots numbers."""
        return F.element_at(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), slot + 1)


def balanced(load: list[int], n_shards: int) -> SlotMap:
    """Heaviest slot first to the lightest shard."""
    heap = [(0, k) for k in range(n_shards)]
    owners = [0] * len(load)
    for slot in sorted(range(len(load)), key=lambda s: (-load[s], s)):
        total, shard = heapq.heappop(heap)
        owners[slot] = shard
        heapq.heappush(heap, (total + load[slot], shard))
    return SlotMap(owners, n_shards)


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot, from rows with columns slot_id and size."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("slot_id").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.slot_id], count[r.slot_id] = r.b, r.n
    return size, count


def store(spark: SparkSession, where: str, slots: SlotMap) -> None:
    """Write one version of a map to the folder `where`; a version is never written twice."""
    every = spark.range(len(slots.shard_of)).select(F.col("id").cast("int").alias("slot_id"), slots.column(slots.shard_of, F.col("id").cast("int")).cast("int").alias("shard"))
    every.coalesce(1).withColumn("n_shards", F.lit(slots.n_shards)).write.mode("error").parquet(f"{where}/version={slots.version}")


def stored(spark: SparkSession, where: str, version: int) -> DataFrame:
    """(slot_id, shard, n_shards) of a version of the map in the folder `where`."""
    return spark.read.schema("slot_id int, shard int, n_shards int").parquet(f"{where}/version={version}")


def load(spark: SparkSession, where: str, version: int) -> SlotMap:
    rows = stored(spark, where, version).orderBy("slot_id").collect()  # n_slots rows
    return SlotMap([r.shard for r in rows], rows[0].n_shards, version)


def shard(docs: DataFrame, key: str, text: str, n_shards: int, n_slots: int = N_SLOTS, where: str | None = None, version: int | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, slot_id, shard, slot, map_version, next_shard): slot is the row's
    place in its shard, gapless from 0; next_shard is where the map's next version, for one shard more,
    puts it.

    The slot is a hash of key and text, so rows of one repeated key, or of none, spread by their texts.
    `where` is the folder of the map. With `version`, that version of it is followed; else version 1 is
    made, nearly equal in bytes. The next version is the edit of the one that is followed.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.struct(F.col(key), F.col(text)), n_slots).alias("slot_id"),
    )
    size, count = slot_loads(rows.select("slot_id", "size"), n_slots)
    where = where or fresh_path(spark, "slot-map")
    if version is None:
        version = 1
        store(spark, where, balanced(size, n_shards))
    slots = load(spark, where, version)
    store(spark, where, slots.grow(size))
    first, seen = [0] * n_slots, [0] * slots.n_shards
    for s, k in enumerate(slots.shard_of):
        first[s], seen[k] = seen[k], seen[k] + count[s]
    place = F.row_number().over(Window.partitionBy("slot_id").orderBy(F.col(key), "text_crc32", "size")) - 1
    owners = stored(spark, where, version).select("slot_id", "shard").join(stored(spark, where, version + 1).select("slot_id", F.col("shard").alias("next_shard")), "slot_id")
    return rows.withColumn("place", place).join(F.broadcast(owners), "slot_id").select(
        key, "size", "text_crc32", "slot_id", "shard",
        (slots.column(first, F.col("slot_id")) + F.col("place")).cast("bigint").alias("slot"),
        F.lit(version).alias("map_version"), "next_shard",
    )
