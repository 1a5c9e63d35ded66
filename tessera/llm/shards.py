"""Sharding by fixed virtual slots: records hash into slots, and a versioned map, edited when rebalancing, puts slots on shards.

A slot that holds far more than others, as where one record stands on many rows, is split into further slots.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import new_path, table, written

N_SLOTS = 8192


#: Times the mean of slots beyond which one is split.
HOT = 4


def with_virtual_slot(df: DataFrame, *keys: str, n_slots: int = N_SLOTS, name: str = "virtual_slot") -> DataFrame:
    """Adds the slot that the record's keys hash to; null keys have one too."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(n_slots)).cast("int"))


def hot_slots(loads: dict[int, tuple[int, int]], n_slots: int) -> list[tuple[int, int, int]]:
    """(slot, first of its further slots, how many) of slots with over HOT times the mean of bytes or rows, and over one row."""
    mean = [sum(x[i] for x in loads.values()) / n_slots for i in (0, 1)]
    found, following = [], n_slots
    for slot, load in sorted(loads.items()):
        ratio = max(load[0] / mean[0], load[1] / mean[1])
        parts = min(math.ceil(ratio), load[1])
        if ratio > HOT and parts > 1:
            found.append((slot, following, parts))
            following += parts
    return found


def split_hot(df: DataFrame, hot: list[tuple[int, int, int]], row: str) -> DataFrame:
    """df with the rows of hot slots dealt to their further slots by a number that each row has."""
    if not hot:
        return df
    # No more rows than there are slots.
    more = df.sparkSession.createDataFrame(hot, "virtual_slot int, _from int, _parts int")
    dealt = F.col("_from") + F.pmod(F.xxhash64(F.lit("split"), row), F.col("_parts")).cast("int")
    return df.join(F.broadcast(more), "virtual_slot", "left").withColumn("virtual_slot", F.coalesce(dealt, "virtual_slot")).drop("_from", "_parts")


def slot_loads(df: DataFrame, size: str = "size", slot: str = "virtual_slot") -> dict[int, tuple[int, int]]:
    """{slot: (bytes, rows)}; at most one entry for each virtual slot comes to the driver, whatever the input."""
    return {r[0]: (r[1], r[2]) for r in df.groupBy(slot).agg(F.sum(size), F.count(F.lit(1))).collect()}


@dataclass
class SlotMap:
    """shard_of[slot], and a version that grows by one with every edit."""

    shard_of: list[int]
    n_shards: int
    version: int = 0

    @classmethod
    def uniform(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return cls([slot % n_shards for slot in range(n_slots)], n_shards)

    def grown(self, n_shards: int) -> SlotMap:
        """With more shards: slots move only to the new ones, the same number from each old one."""
        shard_of, n = list(self.shard_of), self.n_shards
        while n < n_shards:
            slots = {s: [i for i, x in enumerate(shard_of) if x == s] for s in range(n)}
            for _ in range(len(shard_of) // (n + 1)):
                shard_of[slots[max(slots, key=lambda s: (len(slots[s]), -s))].pop()] = n
            n += 1
        return SlotMap(shard_of, n_shards, self.version + 1)

    def rebalanced(self, loads: dict[int, int]) -> SlotMap:
        """Evens out the shards' bytes by moving slots, and swapping them where no move helps, from the fullest shard to the emptiest."""
        shard_of = list(self.shard_of)
        total = [0] * self.n_shards
        held: list[list[tuple[int, int]]] = [[] for _ in total]
        for slot in range(len(shard_of)):
            total[shard_of[slot]] += loads.get(slot, 0)
        # Slots above the mean of their shard leave first, the largest first: each goes to the shard that is then emptiest.
        mean = sum(total) / max(1, self.n_shards)
        moving = []
        for slot in sorted(range(len(shard_of)), key=lambda s: (-loads.get(s, 0), s)):
            shard, size = shard_of[slot], loads.get(slot, 0)
            if size and total[shard] > mean:
                total[shard] -= size
                moving.append((slot, size))
            else:
                held[shard].append((size, slot))
        heap = [(t, s) for s, t in enumerate(total)]
        heapq.heapify(heap)
        for slot, size in moving:
            t, s = heapq.heappop(heap)
            shard_of[slot] = s
            held[s].append((size, slot))
            heapq.heappush(heap, (t + size, s))
        total = [0] * self.n_shards
        for t, s in heap:
            total[s] = t
        for _ in range(4 * len(shard_of)):
            high, low = max(range(self.n_shards), key=total.__getitem__), min(range(self.n_shards), key=total.__getitem__)
            gap = total[high] - total[low]
            best, choice = gap, None
            low_slots = sorted(held[low])
            for size, slot in held[high]:
                if 0 < size < gap and abs(gap - 2 * size) < best:
                    best, choice = abs(gap - 2 * size), (slot, size, None, 0)
                k = _nearest(low_slots, size - gap / 2)
                if k is not None and 0 < (d := size - low_slots[k][0]) < gap and abs(gap - 2 * d) < best:
                    best, choice = abs(gap - 2 * d), (slot, size, low_slots[k][1], low_slots[k][0])
            if choice is None or gap <= mean / 1e4 or best >= gap:
                break
            slot, size, other, other_size = choice
            held[high].remove((size, slot))
            held[low].append((size, slot))
            shard_of[slot] = low
            if other is not None:
                held[low].remove((other_size, other))
                held[high].append((other_size, other))
                shard_of[other] = high
            total[high] += other_size - size
            total[low] += size - other_size
        return SlotMap(shard_of, self.n_shards, self.version + 1)


def _nearest(ordered: list[tuple[int, int]], size: float) -> int | None:
    import bisect

    k = bisect.bisect_left(ordered, (size, -1))
    near = [i for i in (k - 1, k) if 0 <= i < len(ordered)]
    return min(near, key=lambda i: abs(ordered[i][0] - size), default=None)


_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType(), False) for n in ("version", "n_shards", "virtual_slot", "shard")]
)


class SlotMapStore:
    """Versions of the map under a path: one immutable folder for each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, slot_map: SlotMap) -> None:
        rows = [(slot_map.version, slot_map.n_shards, i, s) for i, s in enumerate(slot_map.shard_of)]
        self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{self.path}/v{slot_map.version:09d}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/v{version:09d}")


def assign(df: DataFrame, slot_map: DataFrame, loads: dict[int, tuple[int, int]], shard_of: list[int], order: list[str]) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, 0, 1, 2 and so on.

    A shard's virtual slots stand one after another in order of their number; rows in a virtual slot in the given order.
    So places are counted within a virtual slot only, and no task gets more than one slot's rows together.
    """
    first, at = {}, {}
    for slot, shard in enumerate(shard_of):
        first[slot] = at.get(shard, 0)
        at[shard] = first[slot] + loads.get(slot, (0, 0))[1]
    # Both have one row for each virtual slot: a broadcast of a fixed size.
    starts = df.sparkSession.createDataFrame(list(first.items()), "virtual_slot int, _first long")
    places = slot_map.select("virtual_slot", "shard").join(F.broadcast(starts), "virtual_slot")
    within = Window.partitionBy("virtual_slot").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(places), "virtual_slot")
        .withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_row", "_first")
    )


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, store: SlotMapStore | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: documents over n_shards of near equal bytes.

    size is the text's UTF-8 bytes plus 8; a null text has none. Records hash into slots by doc_id and the text's CRC, so
    that a null or repeated doc_id spreads; equal texts of differing doc_ids aren't kept together, as a group of copies may
    be larger than a shard. Rows alike in both, where they are many, are dealt out to further slots by their place in the
    table. Version 0 of the map deals slots out in turn, version 1 is edited for the bytes counted; both are in the store.
    slot counts a shard's rows, without gaps. Other columns play no part; an empty table gives no row.
    """
    spark = docs.sparkSession
    store = store or SlotMapStore(spark, new_path(spark, "slotmap"))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    slim = with_virtual_slot(slim, "doc_id", "text_crc32", n_slots=n_slots).withColumn("row", F.monotonically_increasing_id())
    slim = written(slim, "sizes")
    loads = slot_loads(slim)
    if hot := hot_slots(loads, n_slots):
        slim = split_hot(slim, hot, "row")
        loads = slot_loads(slim)
    initial = SlotMap.uniform(n_shards, n_slots + sum(parts for _, _, parts in hot))
    store.save(initial)
    edited = initial.rebalanced({slot: size for slot, (size, _) in loads.items()})
    store.save(edited)
    return assign(slim, store.load(edited.version), loads, edited.shard_of, ["doc_id", "text_crc32", "row"]).drop("row")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
