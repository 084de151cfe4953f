"""Sharding by fixed virtual slots.

A document's id hashes into one of SLOTS virtual slots, for ever.  Bytes are summed by slot, and a small
versioned map sends each slot to a shard.  Version 0 gives the heaviest slots first to the lightest shards;
every later call loads the last version and rebalance() edits it: it moves only as many slots as it must to even the bytes or to serve a new shard count.

Law: `bytes` (sizes near equal: within the heaviest slot, so within the heaviest document at worst).
`slot` numbers the rows of a shard from 0 without gaps: the offset of a part of a virtual slot in its shard plus the row's place
in the part.  Rows equal in id and text are counted before they meet, and PARTS parts by text split a slot, so that neither a hot
document nor a hot id puts its rows into one task.

Defined results: a null text has no bytes (size 1) and the crc32 of the empty text; null ids share a slot by their
text; rows that repeat id and text share a slot; an empty table gives an empty result; other columns are ignored
by place() and kept by assign().
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, kept_path, small, stage

SLOTS, SHARDS = 4096, 16
#: Parts of a slot that are numbered apart, and the most places an array holds.
PARTS, RUN = 32, 10_000


def slot_of(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    """Null ids are told apart by their text."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(crc)).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def first_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Heaviest slot first, each to the lightest shard; slots without rows count 0."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), n + 1, shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """Edits a map: slots of shards that are gone move, then the heaviest shard gives slots to the lightest while that narrows the gap."""
    out = dict(old)
    held: dict[int, set[int]] = defaultdict(set)
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in out.items():
        if shard < shards:
            held[shard].add(slot)
            load[shard] += weights.get(slot, 0)
    for slot in sorted((s for s, shard in out.items() if shard >= shards), key=lambda s: (-weights.get(s, 0), s)):
        to = min(load, key=lambda s: (load[s], s))
        out[slot] = to
        held[to].add(slot)
        load[to] += weights.get(slot, 0)
    for _ in range(4 * len(out)):
        top, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[top] - load[low]
        fits = [s for s in held[top] if 0 < weights.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap - 2 * weights[s]), s))
        out[slot] = low
        held[top].remove(slot)
        held[low].add(slot)
        load[top] -= weights[slot]
        load[low] += weights[slot]
    return out


class SlotMaps:
    """Versions of a slot map, each a table of `slots` rows in a folder of the shared store; the newest is the one in force."""

    SCHEMA = "vslot int, to_shard int, note string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> int | None:
        """The newest version whose table is complete, by a walk from 0."""
        version = None
        while exists(self.spark, f"{self.path}/version={0 if version is None else version + 1}/_SUCCESS"):
            version = 0 if version is None else version + 1
        return version

    def save(self, version: int, mapping: dict[int, int], note: dict | None = None) -> None:
        rows = [(slot, shard, json.dumps(note or {})) for slot, shard in sorted(mapping.items())]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/version={version}")

    def mapping(self, version: int) -> dict[int, int]:
        return {r.vslot: r.to_shard for r in self.load(version).collect()}  # `slots` rows

    def edit(self, weights: dict[int, int], shards: int, slots: int) -> dict[int, int]:
        """The map in force for these weights: the last version, edited where bytes or the shard count ask for it; an edit is a new version."""
        version = self.last()
        old = first_map(weights, shards, slots) if version is None else self.mapping(version)
        new = rebalance(old, weights, shards)
        if version is None or new != old:
            self.save(0 if version is None else version + 1, new, {"shards": shards, "law": "bytes"})
        return new


def maps_of(spark: SparkSession, weights: dict[int, int], shards: int, slots: int) -> SlotMaps:
    """The store for callers that name none: one for each corpus, told by its bytes in each slot, so that reruns read their own map."""
    told = zlib.crc32(json.dumps([shards, slots, sorted(weights.items())]).encode())
    return SlotMaps(spark, kept_path(spark, f"slot-maps-{told:08x}"))


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col="doc_id", text_col="text", maps: SlotMaps | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot for every document.  maps: a store at a stable place, whose last version is edited."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("text_crc32"), slot_of(F.col(id_col), crc, slots).alias("vslot"))
    # Rows that agree in all columns are one row with a number; the parts of a slot are dealt by text, so a hot id is many groups.
    part = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int")
    same = stage(rows.groupBy("vslot", part.alias("part"), "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "shard-rows")
    parts = stage(same.groupBy("vslot", "part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")), "shard-parts")
    weights = {r.vslot: r.bytes for r in parts.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}  # at most `slots` rows
    mapping = (maps or maps_of(docs.sparkSession, weights, shards, slots)).edit(weights, shards, slots)
    table = docs.sparkSession.createDataFrame(sorted(mapping.items()), "v int, shard int")
    # Where each part begins: slots in order inside their shard, parts in order inside their slot.  At most slots x PARTS rows.
    starts = parts.join(F.broadcast(table), F.col("vslot") == F.col("v")).selectExpr("vslot", "part", "shard", "sum(n) OVER (PARTITION BY shard ORDER BY vslot, part) - n AS first")
    begun = same.selectExpr("*", "sum(n) OVER (PARTITION BY vslot, part ORDER BY doc_id, text_crc32, size) - n AS before").join(small(stage(starts, "shard-starts")), ["vslot", "part"])
    # A row that stands for many is given back in steps of RUN, so that no array is long.
    steps = begun.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("before")).alias("lo"), (F.col("first") + F.col("before") + F.col("n") - 1).alias("hi"))
    steps = steps.withColumn("at", F.explode(F.sequence("lo", "hi", F.lit(RUN))))
    return steps.select("doc_id", "size", "text_crc32", "vslot", "shard", F.explode(F.sequence("at", F.least("hi", F.col("at") + RUN - 1))).alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col="doc_id", text_col="text", maps: SlotMaps | None = None) -> DataFrame:
    """The documents with shard and virtual slot added (replacing columns of those names); texts are not shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    v = slot_of(F.col(id_col), F.crc32(text.cast("binary")), slots)
    per = docs.select(v.alias("v"), (F.octet_length(text).cast("long") + 1).alias("size")).groupBy("v").agg(F.sum("size").alias("bytes")).collect()  # at most `slots` rows
    weights = {r.v: r.bytes for r in per}
    mapping = (maps or maps_of(docs.sparkSession, weights, shards, slots)).edit(weights, shards, slots)
    table = docs.sparkSession.createDataFrame(sorted(mapping.items()), "__sl_v int, __sl_shard int")
    keep = [c for c in docs.columns if c not in ("shard", "virtual_slot")]
    return docs.withColumn("__sl_slot", v).join(F.broadcast(table), F.col("__sl_slot") == F.col("__sl_v")).select(*keep, F.col("__sl_slot").alias("virtual_slot"), F.col("__sl_shard").alias("shard"))  # broadcast: `slots` rows


def query(docs: DataFrame) -> DataFrame:
    return place(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
