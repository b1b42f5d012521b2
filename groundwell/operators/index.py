"""The stored index of a chunk table: chunks, positional postings, a sorted term dictionary, and vectors by pivot.

Each batch of chunks is one segment, written once and never rewritten. A segment holds

* `chunks`: the rows of the batch with `seq`, a number no other chunk of the index has;
* `postings`: per (knowledge base, part, term) the chunks that hold the term, with counts and positions. A part holds at most
  `rows_per_part` chunks of one knowledge base, of those one task read, so a posting row and a key have a bounded size and no
  text is shuffled. One folder, a file a task, sorted by knowledge base, the first two characters and the term;
* `terms`: the sorted dictionary, the distinct terms of all knowledge bases, numbered and in blocks, and `fences`, the first
  key of each block;
* `vectors`: see `operators.semantic`.

Which chunks are live follows from a small manifest of version and segment: the newest segment of a version counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions import text as T
from groundwell.sources.ranges import numbered, range_parts, running_total

#: chunk numbers of one segment
_SEGMENT_BITS = 46
#: parts of one task
_PART_BITS = 24
#: bytes of stored chunks that one task inverts
_TASK_BYTES = 32 * 2**20
_POSTINGS = "kb_id string, part long, term string, seqs array<long>, counts array<int>, positions array<array<int>>"


def lexical_document(chunks: DataFrame) -> DataFrame:
    """Add `words`, the positions of the searchable text of a chunk."""
    text = F.concat_ws(
        " ", "search_text", F.coalesce("section_title", F.lit("")),
        F.coalesce("source_title", F.lit("")), "document_title",
    )
    return chunks.withColumn("words", T.words_by_position(text))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]])


def invert(rows_per_part: int):
    """Rows (kb_id, seq, words) of one task, in order of kb_id, to posting rows: one per batch, part and term. A part is
    rows_per_part chunks of one knowledge base that one task read, so no chunk moves to where its part is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = (TaskContext.get().partitionId() << _PART_BITS) - 1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kb, seq, words = batch.columns
            starts = _runs(kb.dictionary_encode().indices.to_numpy())
            part = np.empty(batch.num_rows, np.int64)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                name = kb[a].as_py()
                if name != last:
                    number, held, last = number + 1, 0, name
                place = held + np.arange(b - a)
                part[a:b] = number + place // rows_per_part
                number, held = int(part[b - 1]), int(place[-1] % rows_per_part) + 1
            yield _postings(kb, part, seq, words)

    return run


def _postings(kb: pa.Array, part: np.ndarray, seq: pa.Array, words: pa.Array) -> pa.RecordBatch:
    sizes = np.diff(words.offsets.to_numpy())
    row = np.repeat(np.arange(len(part)), sizes)
    position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    encoded = words.flatten().dictionary_encode()
    key = (part - part[0])[row] * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy()
    order = np.argsort(key, kind="stable")  # rows and positions of a key stay ascending
    key, row, position = key[order], row[order], position[order]
    cell = _runs(key * len(part) + row)  # a chunk of a term
    first = cell[:-1]
    group = _runs(key[first])  # a term of a part
    head = first[group[:-1]]
    lists = pa.array(group, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            kb.take(pa.array(row[head])), pa.array(part[row[head]]),
            encoded.dictionary.take(pa.array(key[head] % max(1, len(encoded.dictionary)))),
            pa.ListArray.from_arrays(lists, seq.take(pa.array(row[first]))),
            pa.ListArray.from_arrays(lists, pa.array(np.diff(cell), pa.int32())),
            pa.ListArray.from_arrays(lists, pa.ListArray.from_arrays(pa.array(cell, pa.int32()), pa.array(position, pa.int32()))),
        ],
        ["kb_id", "part", "term", "seqs", "counts", "positions"],
    )


@dataclass(frozen=True)
class ChunkIndex:
    """The segments below one shared folder."""

    spark: SparkSession
    root: str
    segments: int = 1

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def chunks(self) -> DataFrame:
        """Chunks of the newest segment of their version."""
        rows = self.table("chunks")
        newest = self.table("versions").groupBy("version_id").agg(F.max("segment").alias("segment"))
        return rows.join(newest, ["version_id", "segment"], "left_semi") if self.segments > 1 else rows

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def terms(self) -> DataFrame:
        return self.table("terms")

    @property
    def vectors(self) -> DataFrame:
        return self.table("vectors")

    @property
    def blocks(self) -> DataFrame:
        return self.table("blocks")


def add_segment(chunks: DataFrame, root: str, segment: int = 0, rows_per_part: int = 100_000) -> ChunkIndex:
    """Write a batch of chunks as a segment of the index below root. Repeating it overwrites the same folders; older chunks of
    the versions it brings are dead from now on, and no older file is touched. The text of the batch is read once."""
    spark = chunks.sparkSession
    number = F.monotonically_increasing_id() + F.lit(segment << _SEGMENT_BITS)
    chunks.withColumn("seq", number).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/chunks/segment={segment}")
    stored = spark.read.parquet(f"{root}/chunks/segment={segment}")
    stored.select("version_id").distinct().write.mode("overwrite").parquet(f"{root}/versions/segment={segment}")

    texts = stored.filter("kb_id IS NOT NULL").sortWithinPartitions("kb_id")
    head = F.substring("term", 1, 2)
    # what a task sorts and inverts has to fit its memory: a split of the chunk files is smaller here than elsewhere
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(_TASK_BYTES))
    try:
        (
            lexical_document(texts).select("kb_id", "seq", "words").mapInArrow(invert(rows_per_part), _POSTINGS)
            .withColumn("part", F.col("part") + F.lit(segment << _SEGMENT_BITS)).withColumn("head", head)
            .sortWithinPartitions("kb_id", "head", "term").write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/postings/segment={segment}")
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    written = spark.read.parquet(f"{root}/postings/segment={segment}")
    write_sorted(written.select(F.col("term").alias("key")), root, "terms", segment)
    return ChunkIndex(spark, root, segment + 1)


_AFTER = "\U0010ffff"


def write_sorted(rows: DataFrame, root: str, name: str, segment: int, per_block: int = 256) -> None:
    """Distinct rows(key, ...) of a segment in order of key, in blocks of per_block rows; and the first key of each block. Rows are
    shuffled once, by range of the key; equal ones meet there."""
    ranged = rows.repartitionByRange(range_parts(rows), "key").distinct()
    numbered(ranged, ["key"], F.lit(1), "number").withColumn("block", F.expr(f"number div {per_block}")).write.mode("overwrite").parquet(f"{root}/{name}/segment={segment}")
    stored = rows.sparkSession.read.parquet(f"{root}/{name}/segment={segment}")
    stored.groupBy("block").agg(F.min("key").alias("first")).write.mode("overwrite").parquet(f"{root}/{name}-fences/segment={segment}")


def with_prefix(index: ChunkIndex, name: str, prefixes: DataFrame) -> DataFrame:
    """Rows of a sorted table joined to every `prefix` of prefixes that their key starts with; other columns of prefixes are left out.

    What starts with a prefix is one interval of the sorted table, and the blocks it lies in are one interval of blocks. Both ends
    of every prefix take their place among the first keys of the blocks: that is all that is sorted. Then a prefix meets the rows
    of its blocks by block number."""
    fences = index.table(f"{name}-fences")
    line = fences.select("segment", F.col("first").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"))
    ends = prefixes.select("prefix").distinct().select(
        F.explode(F.array(*map(F.lit, range(index.segments)))).alias("segment"), "prefix",
    ).select("segment", "prefix", F.explode(F.array(
        F.struct(F.col("prefix").alias("key"), F.lit(0).alias("kind")), F.struct(F.concat("prefix", F.lit(_AFTER)).alias("key"), F.lit(2).alias("kind")),
    )).alias("e")).select("segment", "e.key", "e.kind", "prefix")
    placed = running_total(line.unionByName(ends), ["segment", "key", "kind"], F.col("kind") == 1, "blocks")
    held = fences.groupBy("segment").agg(F.count("*").alias("own"))
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("segment", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("earlier"))  # a row a segment
    interval = placed.filter("kind <> 1").groupBy("segment", "prefix").agg(F.min("blocks").alias("low"), F.max("blocks").alias("high")).join(held, "segment")
    # the block that begins before the prefix may hold its first rows
    low, high = F.greatest(F.col("low") - F.col("earlier") - 1, F.lit(0)), F.col("high") - F.col("earlier") - 1
    looked = interval.filter(high >= 0).select("segment", "prefix", F.explode(F.sequence(low, high)).alias("block"))
    return index.table(name).join(looked, ["segment", "block"]).filter(F.startswith("key", "prefix")).drop("number", "block", "segment")


def prefix_terms(index: ChunkIndex, prefixes: DataFrame) -> DataFrame:
    """(prefix, term) for every distinct `term` of the index that starts with a `prefix` of prefixes."""
    found = with_prefix(index, "terms", prefixes).select("prefix", F.col("key").alias("term"))
    return found if index.segments == 1 else found.distinct()


def scoped_postings(index: ChunkIndex, asked: DataFrame, matches: Column) -> DataFrame:
    """Posting rows joined to the rows asked(kb_id, head, ...) of their knowledge base for which `matches` holds; `head` is the first
    two characters of a prefix of two characters or more. Few rows share a knowledge base and a head, so the postings are read
    where they lie and asked, which should be a written table, goes to them; only if it is large are both shuffled."""
    return index.postings.join(asked, ["kb_id", "head"]).filter(matches)


def chunk_keys(index: ChunkIndex) -> DataFrame:
    """What a match needs of its chunk: no text."""
    return index.chunks.select("seq", "chunk_id", "doc_id", "language", "indexed_at")
