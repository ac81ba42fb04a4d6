"""Sharding over fixed virtual slots.

Every record hashes by its key into one of ``SLOTS`` virtual slots, for good. Bytes and rows are summed per slot,
and a versioned slot-to-shard map, edited when the load shifts, says where each slot lives. Only DataFrame functions
touch the records; the map itself has ``SLOTS`` entries whatever the size of the corpus, so the driver plans it. Records go
by their key alone: equal texts under different keys may lie in different shards, as the law is that of bytes.

Defined results: a null key is a key like any other; a null or empty text has size 1; repeated rows share a virtual
slot and get different positions in it; an empty table gives an empty result and a balanced map; columns of the input
other than the key and the text are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .common import fresh_path, long_array, table, text_of

SLOTS = 4096
SHARDS = 16


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of every virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, load: list[int], shards: int | None = None, slack: float = 0.001) -> SlotMap:
        """The next version: slots move one by one off shards above the mean, the largest first, onto the emptiest.

        A slot stays where it is as long as its shard is not above the mean by more than ``slack``, so an edit moves
        little data. Slots of shards that no longer exist move.
        """
        shards = shards or self.shards
        mean = sum(load) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        adrift = []
        for slot, shard in enumerate(self.shard_of):
            (held[shard] if shard < shards else adrift).append(slot)
        filled = [0] * shards
        for shard, slots in enumerate(held):
            for slot in sorted(slots, key=lambda s: (-load[s], s)):
                if filled[shard] + load[slot] > mean * (1 + slack) and load[slot]:
                    adrift.append(slot)
                else:
                    filled[shard] += load[slot]
        shard_of = list(self.shard_of)
        room = [(filled[k], k) for k in range(shards)]
        heapq.heapify(room)
        for slot in sorted(adrift, key=lambda s: (-load[s], s)):
            bytes_there, shard = heapq.heappop(room)
            shard_of[slot] = shard
            heapq.heappush(room, (bytes_there + load[slot], shard))
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def column(self, slot: Column) -> Column:
        return F.element_at(long_array(self.shard_of), slot + 1).cast("int")


def slot_sizes(df: DataFrame, size: Column, key: str, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot; at most ``slots`` rows reach the driver."""
    sums = df.groupBy(virtual_slot(F.col(key), slots).alias("s")).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    load, rows = [0] * slots, [0] * slots
    for s, b, n in sums.collect():
        load[s], rows[s] = b, n
    return load, rows


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version of the map to the table at ``path``; earlier versions stay readable."""
    (
        spark.range(len(slot_map.shard_of))
        .select(F.lit(slot_map.version).alias("version"), F.lit(slot_map.shards).alias("shards"), F.col("id").cast("int").alias("slot"), slot_map.column(F.col("id").cast("int")).alias("shard"))
        .coalesce(1).write.mode("append").parquet(path)
    )


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map, the latest by default."""
    maps = spark.read.parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    rows = maps.filter(F.col("version") == version).orderBy("slot").select("shard", "shards").collect()
    return SlotMap(version, rows[0][1], tuple(r[0] for r in rows))


def assign(df: DataFrame, slot_map: SlotMap, rows: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and gapless position in the shard of every record.

    A shard's slots lie one behind the other; ``rows`` (of each slot) gives where each begins, so a position needs a
    sort within one virtual slot only.
    """
    begins, after = [0] * len(rows), [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        begins[slot], after[shard] = after[shard], after[shard] + rows[slot]
    content = text_of(text)
    slotted = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
        virtual_slot(F.col(key), len(rows)).alias("virtual_slot"),
    )
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return slotted.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        slot_map.column(F.col("virtual_slot")).alias("shard"),
        (F.element_at(long_array(begins), F.col("virtual_slot") + 1) + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place; the map is saved and read back."""
    docs = table(spark, sf_dir, "documents")
    load, rows = slot_sizes(docs, F.octet_length(text_of()) + 1, "doc_id")
    first = SlotMap.initial()
    path = fresh_path(spark, "slot-map")
    save_map(spark, first, path)
    save_map(spark, first.rebalanced(load), path)
    return assign(docs, load_map(spark, path), rows)
