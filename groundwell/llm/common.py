"""Helpers shared by the operators: the shared folder, Arrow text as numpy bytes, words, row filters."""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.sources.tables import settle, shared_dir

__all__ = ["settle", "shared_dir", "bounded_batches", "tidied", "once_a_worker", "documents", "utf8", "rows_of", "hash_words", "range_hashes", "mixed", "hash_sample", "keep_rows", "parts_for", "slices", "MIX"]

#: odd multiplier of the 64-bit mixing steps
MIX = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def tidied(run):
    """A batch function that gives back, when its task ends, what it holds only for speed. Workers live on between the stages of an
    application, beside a growing JVM: tables of powers, Arrow's pool and the allocator's free lists would stay with them."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return tidy


def once_a_worker(cache: dict, content: bytes | str, *extra, make):
    """make(), kept in cache under the content: of several contents a worker keeps the last only."""
    key = (hashlib.sha256(content.encode() if isinstance(content, str) else content).digest(), *extra)
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB and 2,000 rows from here on: a task's Python memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values; bounded by one batch."""
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base to the power 0, 1, ..., n - 1 modulo 2^64; kept between calls up to 2^21 of them (16 MB)."""
    if n > 1 << 21:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    base = int(MIX)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, _powers(len(data), base), out=sums[1:])
    np.cumsum(sums, out=sums)
    size = (ends - starts).astype(np.uint64)
    # the length keeps ranges apart that differ in zero bytes at the end only
    return mixed((sums[ends] - sums[starts]) * _powers(len(data) + 1, pow(base, -1, 1 << 64))[starts] + size * np.uint64(0xA0761D6478BD642F))


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each, a row at least; they stay in the processor's cache."""
    begun, (_, offsets) = 0, utf8(batch.column(column))
    while begun < batch.num_rows:
        end = max(begun + 1, int(np.searchsorted(offsets, offsets[begun] + size, "right")) - 1)
        yield batch.slice(begun, end - begun)
        begun = end


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words before each text.

    A word is a run of bytes other than ASCII white space; A-Z count as a-z. No word crosses two texts.
    """
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    # a word ends before the next byte that is outside or that begins another word
    stops = np.ones(len(data) + 1, bool)
    stops[:-1] = ~inside | begins
    stop_at = np.flatnonzero(stops)
    ends = stop_at[np.searchsorted(stop_at, starts, side="right")]
    return range_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that none gets more than about per_part rows."""
    return max(least, math.ceil(rows / per_part))


def hash_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The `most` rows of smallest hash of the keys. Rows are counted first, so that a task sends about its share of them and
    not `most` rows each; the sample is the same however the rows are partitioned."""
    total = rows.count()
    drawn = rows.withColumn("__h", F.xxhash64(*keys))
    if total > 4 * most:
        # twice the share, and a margin for chance: the smallest hashes lie below this bound all but certainly
        share = (2 * most + 200) / total
        drawn = drawn.filter(F.col("__h") <= min(int(-(2**63) + share * 2**64), 2**63 - 1))
    return drawn.orderBy("__h", *keys).limit(most).drop("__h")


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame, once: bool = False) -> DataFrame:
    """Rows of docs whose key is in the only column of kept, null matching null; all columns of docs, unchanged.

    once: of rows that repeat both doc_id and text one stays. Only repeated ids are shuffled for that.
    """
    ids = kept.select(F.col(kept.columns[0]).alias("__keep")).distinct()
    out = docs.join(ids, key.eqNullSafe(F.col("__keep")), "left_semi")
    if not once:
        return out
    again = docs.groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again")
    twice = F.col("doc_id").eqNullSafe(F.col("__again"))
    return out.join(again, twice, "left_anti").unionByName(out.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
