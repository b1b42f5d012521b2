"""Balanced shards: longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import parts_for, settle


def least_loaded(sizes: list[tuple], loads: list[int]) -> list[int]:
    """The shard of each item (size first): largest first, each to the least-loaded shard. Adds to loads."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1:])):
        load, shard = heap[0]
        out[i] = shard
        loads[shard] = load + sizes[i][0]
        heapq.heapreplace(heap, (loads[shard], shard))
    return out


def _bins(count: int):
    """Rows (part, key, bytes), sorted by part and falling size, into bins that each part has for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap = None, []
        for batch in batches:
            bins = []
            for part, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != current:
                    current, heap = part, [(0, b) for b in range(count)]
                load, b = heap[0]
                heapq.heapreplace(heap, (load + size, b))
                bins.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], ["part", "key", "bytes", "bin"])

    return run


def lpt_shards(docs: DataFrame, shards: int = 8, fine: int = 64, groups_per_part: int = 1_000_000) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text and 1; a null text has size 1 and is grouped with the empty one. Rows of equal
    text share a shard. slot numbers the rows of a shard without gaps, by blocks of a hash and doc_id within them.
    Other columns are ignored; an empty table gives no rows.

    Groups with more than 1/(shards * fine) of all bytes or rows are at most 2 * shards * fine; the driver places them
    first, largest first, on a heap. All others go to a part by hash, where they are placed in order of size on a heap of
    the part's own bins; then the bins, 4096 in all or 16 a part, are placed like single groups. So no task sees more
    than its share, and shards differ by about one bin (1/4096 of all bytes).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")),
        "shard-keys",
    )
    groups = keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = keyed.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r")).first()
    cut = shards * fine
    large = F.expr(f"bytes > {total['b'] or 0} / {cut}D OR rows > greatest({total['r']} / {cut}D, 1)")
    top = groups.filter(large).orderBy("key").collect()  # at most 2 * cut rows
    loads = [0] * shards
    where = least_loaded([(g["bytes"], bytes(g["key"])) for g in top], loads)
    top_shards = spark.createDataFrame([(bytes(g["key"]), s) for g, s in zip(top, where, strict=True)], "key binary, top_shard int")

    parts = parts_for(total["r"], groups_per_part, 8)
    bins = max(16, 4096 // parts)
    placed = settle(
        groups.filter(~large).select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "bytes")
        .repartition(parts, "part").sortWithinPartitions("part", F.desc("bytes"), "key")
        .mapInArrow(_bins(bins), "part int, key binary, bytes long, bin int"),
        "shard-bins",
    )
    filled = placed.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).orderBy("part", "bin").collect()  # bins * parts rows at most
    where = least_loaded([tuple(x) for x in ((r["bytes"], r["part"], r["bin"]) for r in filled)], loads)
    bin_shards = spark.createDataFrame([(r["part"], r["bin"], s) for r, s in zip(filled, where, strict=True)], "part int, bin int, shard int")

    marked = keyed.join(F.broadcast(top_shards), "key", "left")
    hot = marked.filter("top_shard IS NOT NULL").select("doc_id", "size", "text_crc32", F.col("top_shard").alias("shard"))
    cold = (
        marked.filter("top_shard IS NULL").join(placed.select("key", "part", "bin"), "key")
        .join(F.broadcast(bin_shards), ["part", "bin"]).select("doc_id", "size", "text_crc32", "shard")
    )
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts * 8)).cast("int")
    assigned = settle(hot.unionByName(cold).withColumn("block", block), "shard-rows")
    counts = assigned.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        assigned.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
    )
