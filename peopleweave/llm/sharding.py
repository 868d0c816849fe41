"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups are sorted by size and each goes to the least loaded shard,
taken from a heap. So that the schedule never grows with the data, groups below 1/``UNITS`` of all bytes
are first bundled by hash into at most ``UNITS`` bundles, which are scheduled like groups; at most ``UNITS`` groups
are larger. The driver so sees at most 2 * ``UNITS`` sizes, and shards differ by about one bundle.
"""
from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UNITS = 16_384
SLOT_ROWS = 50_000   # about the rows numbered in one task


def schedule(sizes: list[tuple], shards: int) -> dict:
    """unit -> shard for (unit, size) pairs: largest first, ties by unit, to the least loaded shard (ties: lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int = 8, *, text_col: str = "text", units: int = UNITS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null, as the law is not by key).

    A null text counts as the empty one: size 1, crc32 0, one group with the empty texts. Repeated rows each get a slot.
    Slots of a shard are gapless from 0. Kept columns with a result's name are replaced. No rows give no rows.
    """
    spark = docs.sparkSession
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in kept], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.unhex(F.sha2(text.cast("binary"), 256)).alias("__group"), F.monotonically_increasing_id().alias("__row")), "shards")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = stored(rows.groupBy("__group").agg(F.sum("size").alias("bytes")), "groups")
    bundle = F.pmod(F.xxhash64("__group"), F.lit(units))
    large = F.col("bytes") * units > total
    whole = [(bytes(g), b) for g, b in groups.filter(large).select("__group", "bytes").collect()]
    bundles = groups.filter(~large).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = schedule([((0, g), b) for g, b in whole] + [((1, b), n) for b, n in bundles], shards)
    # Both sides have at most ``units`` rows.
    of_group = spark.createDataFrame([(bytearray(k), s) for (kind, k), s in placed.items() if kind == 0], "__group binary, __s0 int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == 1], "__bundle long, __s1 int")
    rows = rows.withColumn("__bundle", bundle.cast("long")).join(F.broadcast(of_group), "__group", "left").join(F.broadcast(of_bundle), "__bundle", "left")
    rows = rows.withColumn("shard", F.coalesce("__s0", "__s1")).withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(max(1, math.ceil(count / shards / SLOT_ROWS), min(32, count // 1000)))))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "__part").count().select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row"))
    rows = rows.withColumn("__local", local).join(offsets, ["shard", "__part"])
    return rows.select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__local") - 1).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write the documents under ``path``, one folder ``shard=N`` each, with their slot."""
    assign_shards(docs, shards, **options).write.partitionBy("shard").parquet(path)
