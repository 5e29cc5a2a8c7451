"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are summed per slot,
and a small versioned map says which shard holds which slot. Rebalancing edits
the map: whole slots move, records are never hashed anew.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlink.llm.common import workspace

SLOTS = 4096
#: Share of a shard's bytes by which shards may differ before slots move.
EVEN = 0.002


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot.

    Null text counts as empty. The slot hash takes doc_id and text, so records
    with null or repeated ids still spread.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, records, bytes), at most one row a slot."""
    sums = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    return sorted((r["virtual_slot"], r["n"], r["bytes"]) for r in sums)


def rebalance(plan: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for shards (more or fewer than now), with few slots moved.

    Slots of shards that go move to the lightest shards. Those that a shard holds
    beyond an even load move to new shards only, or where there are none to the
    lightest; all others stay where they are. Empty slots are spread by number. A
    map whose loads differ by no more than EVEN is left as it is.
    """
    new = range(max(plan.values(), default=-1) + 1, shards)
    even = sum(weights.values()) / shards
    now = dict.fromkeys(range(shards), 0)
    for slot, shard in plan.items():
        now[shard] = now.get(shard, 0) + weights.get(slot, 0)
    if plan and len(now) == shards and not new and max(now.values()) - min(now.values()) <= EVEN * even:
        return dict(plan)
    load, held, out, loose = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), 0), {}, []
    most = -(-len(plan) // shards)

    def put(slot: int, shard: int) -> None:
        out[slot] = shard
        load[shard] += weights.get(slot, 0)
        held[shard] += 1

    for slot in sorted(plan, key=lambda s: (-weights.get(s, 0), s)):
        shard, weight = plan[slot], weights.get(slot, 0)
        if shard < shards and (load[shard] + weight <= even if weight else held[shard] < most):
            put(slot, shard)
        else:
            loose.append(slot)
    # Slots with bytes go by load, empty ones by number, each to the least so far.
    for weighted in (True, False):
        rank = lambda s: (load[s] if weighted else held[s], held[s], s)
        every, fresh = [sorted(map(rank, own)) for own in (range(shards), new)]
        for slot in loose:
            if (weights.get(slot, 0) > 0) == weighted:
                own = plan[slot]
                heap = fresh if own < shards and new else every
                # An entry that is out of date is lower than the truth: it is put right when it comes up.
                while (least := rank(heap[0][2])) != heap[0]:
                    heapq.heapreplace(heap, least)
                put(slot, own if own < shards and new and rank(own) < heap[0] else heap[0][2])
    return out


class SlotMap:
    """Versions of a slot-to-shard map, each a table under path/version=N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, plan: dict[int, int], weights: dict[int, int]) -> None:
        """Write a version; one that is there already is left alone and raises."""
        rows = [(slot, shard, weights.get(slot, 0)) for slot, shard in sorted(plan.items())]
        df = self.spark.createDataFrame(rows, "virtual_slot int, shard int, slot_bytes long")
        df.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, slot_bytes long").parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(home) if (m := re.search(r"version=(\d+)$", str(s.getPath()))))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All records with their shard, near equal in bytes, and place in it.

    The map under path is edited, never made anew: where there is none, version
    1 deals the slots out in turn; the bytes of the slots then give the next
    version, by rebalance(), unless it equals the last.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the
    shard, gapless from 0), grown_shard (null: the map, not the count of shards,
    decides), virtual_slot, map_version. Slots hash doc_id and text, so that
    documents of equal text spread over the shards. An empty table gives no rows.
    """
    spark, rows = docs.sparkSession, records(docs, slots)
    sums = slot_sums(rows)
    weights = {s: b for s, _, b in sums}
    store = SlotMap(spark, path or workspace(spark, "slot-map"))
    if not (versions := store.versions()):
        store.store(1, {s: s % shards for s in range(slots)}, {})
        versions = [1]
    version = versions[-1]
    last = {r["virtual_slot"]: r["shard"] for r in store.load(version).collect()}
    if (plan := rebalance(last, weights, shards)) != last:
        version += 1
        store.store(version, plan, weights)
    first, at = [], dict.fromkeys(range(shards), 0)
    for slot, n, _ in sums:
        first.append((slot, plan[slot], at[plan[slot]]))
        at[plan[slot]] += n
    placed = F.broadcast(spark.createDataFrame(first, "virtual_slot int, shard int, first long"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("rank", rank).join(placed, "virtual_slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
