"""Exact nearest neighbours by cosine distance, over stored vectors laid out by pivot.

Vectors of one (knowledge base, model, dimension) are written in blocks: each belongs to the nearest of a few pivots and to a
ring of distances around it. On the unit sphere the triangle inequality bounds the distance from a question to all
vectors of a block from its distance to the pivot, so most blocks need no look once a question has k neighbours. A block is bounded
in rows; a knowledge base with a third of all chunks is only more blocks, and no step groups by knowledge base alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from groundwell.functions import fixed_values as V
from groundwell.operators.index import ChunkIndex
from groundwell.sources.tables import settle

_KEYS = ["kb_id", "embedding_model", "embedding_dim"]
# Distances are ranked at this precision, so that the order does not depend on how blocks were cut.
DISTANCE_DIGITS = 12
#: added to every bound: rounding of a distance on the unit sphere
_SLACK = 1e-6
MOST_PIVOTS = 64


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a zero vector becomes a row of NaN."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


# --- stored vectors ----------------------------------------------------------------------------------------------------
def _indexed_us() -> Column:
    """Index time in microseconds; a missing one sorts as the oldest."""
    return F.coalesce(F.unix_micros("indexed_at"), F.lit(-(2**62))).alias("indexed_us")


def block_counts(chunks: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows and parts of each (knowledge base, model, dimension); a part is what one task lays out."""
    n = F.count("*")
    return chunks.groupBy(_KEYS).agg(n.alias("n"), F.ceil(n / chunk_rows).cast("int").alias("parts"))


def _lay_out(block_rows: int, first: str):
    """Vectors of one part and the pivots of its key: nearest pivot, distance, and blocks of at most block_rows in order of both."""

    def run(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return vectors.append_column("pivot", pa.array([], pa.int32())).append_column("block", pa.array([], pa.string())).append_column("radius", pa.array([], pa.float64()))
        order = np.argsort(pivots["pivot"].to_numpy())
        left, right = _matrix(vectors["embedding"]), _matrix(pivots["center"])[order]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * left @ right.T))
        apart = np.where(np.isnan(apart), np.inf, apart)
        pivot = apart.argmin(axis=1).astype(np.int32)
        radius = apart[np.arange(len(left)), pivot]
        order = np.lexsort((radius, pivot))
        begins = np.searchsorted(pivot[order], pivot[order], "left")
        ring = np.empty(len(order), np.int64)
        ring[order] = (np.arange(len(order)) - begins) // block_rows
        part = vectors["part"][0].as_py()
        kb, model = vectors["kb_id"][0].as_py(), vectors["embedding_model"][0].as_py()
        names = [f"{first}{kb}/{model}/{left.shape[1]}/{part}/{p}/{r}" for p, r in zip(pivot.tolist(), ring.tolist(), strict=True)]
        return vectors.append_column("pivot", pa.array(pivot)).append_column("block", pa.array(names)).append_column("radius", pa.array(radius))

    return run


def add_vectors(vectors: DataFrame, root: str, segment: int = 0, block_rows: int = 1024, part_rows: int = 32_768) -> None:
    """Write the vectors of a segment: vectors(seq, chunk_id, doc_id, kb_id, language, indexed_at, embedding_model, embedding_dim,
    embedding); rows without a vector are left out.

    The rows are read three times (counted, pivots drawn, laid out), which moves less than a copy of all vectors would.

    A key has one pivot per block_rows vectors, 64 at most, drawn by hash. A part of at most about part_rows vectors of a key is one task.
    """
    stored = vectors.filter(F.col("embedding").isNotNull()).select(
        *_KEYS, "seq", "chunk_id", "doc_id", F.lower(F.coalesce("language", F.lit(""))).alias("language"), _indexed_us(), "embedding")
    counts = settle(block_counts(stored, part_rows).withColumn("pivots", F.least(F.ceil(F.col("n") / block_rows), F.lit(MOST_PIVOTS)).cast("int")), "vector-counts")
    # a share of all rows that holds the pivots all but certainly; of those the smallest hashes
    drawn = stored.join(counts, _KEYS).withColumn("h", F.xxhash64("seq")).filter((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 4 * F.col("pivots") + 40)
    nth = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("h")) - 1
    pivots = settle(drawn.withColumn("pivot", nth).filter("pivot < pivots").select(*_KEYS, F.col("pivot").cast("int"), F.col("embedding").alias("center"), "parts"), "pivots")
    by = [*_KEYS, "part"]
    cut = stored.join(counts.select(*_KEYS, "parts"), _KEYS).withColumn("part", F.pmod(F.xxhash64("seq", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
    copies = pivots.select(*_KEYS, "pivot", "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    laid = StructType([*cut.schema.fields, StructField("pivot", IntegerType()), StructField("block", StringType()), StructField("radius", DoubleType())])
    cut.groupBy(by).cogroup(copies.groupBy(by)).applyInArrow(_lay_out(block_rows, f"{segment}:"), laid).write.mode("overwrite").parquet(f"{root}/vectors/segment={segment}")
    written = stored.sparkSession.read.parquet(f"{root}/vectors/segment={segment}")
    rings = written.groupBy(*_KEYS, "pivot", "block").agg(F.min("radius").alias("nearest"), F.max("radius").alias("farthest"), F.count("*").alias("rows"))
    rings.join(pivots.drop("parts"), [*_KEYS, "pivot"]).write.mode("overwrite").parquet(f"{root}/blocks/segment={segment}")


# --- search ------------------------------------------------------------------------------------------------------------
def _block_topk(k: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "chunk_id": [], "semantic_distance": [], "indexed_us": []}
        if chunks.num_rows and queries.num_rows:
            distance = np.round(1.0 - _matrix(queries["embedding"]) @ _matrix(chunks["embedding"]).T, DISTANCE_DIGITS)
            ids = chunks["chunk_id"].to_numpy(zero_copy_only=False).astype(str)
            docs = chunks["doc_id"].to_numpy(zero_copy_only=False)
            languages, spoken = np.unique(chunks["language"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            indexed = chunks["indexed_us"].to_numpy(zero_copy_only=False)
            ties = np.lexsort((ids, -indexed))  # once a block
            for row, (query_id, wanted_docs, wanted_languages) in enumerate(
                zip(queries["query_id"].to_pylist(), queries["document_ids"].to_pylist(), queries["languages"].to_pylist())
            ):
                spots = ties
                if wanted_docs:
                    spots = spots[np.isin(docs[spots], wanted_docs)]
                if wanted_languages:
                    spots = spots[np.isin(languages, wanted_languages)[spoken[spots]]]
                order = spots[np.argsort(distance[row, spots], kind="stable")][:k]
                out["query_id"] += [query_id] * len(order)
                out["chunk_id"] += ids[order].tolist()
                out["semantic_distance"] += distance[row, order].tolist()
                out["indexed_us"] += indexed[order].tolist()
        return pa.table(
            out,
            schema=pa.schema([
                ("query_id", queries.schema.field("query_id").type), ("chunk_id", pa.string()),
                ("semantic_distance", pa.float64()), ("indexed_us", pa.int64()),
            ]),
        )

    return run


def _search(pairs: DataFrame, queries: DataFrame, index: ChunkIndex, k: int, query_rows: int) -> DataFrame:
    """The k best per question and block for pairs(query_id, block). Only blocks that are asked for are shuffled; a block that
    many questions ask for is copied once per query_rows of them."""
    slices = pairs.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("slices"))
    left = index.vectors.join(slices, "block").select(
        "block", "chunk_id", "doc_id", "language", "indexed_us", "embedding", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    asked = queries.select("query_id", "document_ids", "languages", "embedding")
    right = pairs.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).join(asked, "query_id")
    right = right.select("block", "slice", "query_id", "document_ids", "languages", "embedding")
    id_type = queries.schema["query_id"].dataType.simpleString()
    by = ["block", "slice"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(
        _block_topk(k), f"query_id {id_type}, chunk_id string, semantic_distance double, indexed_us bigint")


def block_bounds(queries: DataFrame, index: ChunkIndex) -> DataFrame:
    """(query_id, block, rows, least): the least distance on the unit sphere that any vector of the block can have. A zero
    vector has no place on the sphere, so bounds that involve one are 0."""

    def length(name: str) -> Column:
        return F.sqrt(F.aggregate(name, F.lit(0.0), lambda a, x: a + x * x))

    def doubles(name: str) -> Column:
        return F.transform(name, lambda x: x.cast("double"))

    asked = queries.select(*_KEYS, "query_id", doubles("embedding").alias("asked"))
    near = asked.join(index.blocks.select(*_KEYS, "pivot", "segment", doubles("center").alias("center")).dropDuplicates([*_KEYS, "pivot", "segment"]), _KEYS)
    dot = F.aggregate(F.zip_with("asked", "center", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    cosine = F.try_divide(dot, length("asked") * length("center"))
    near = near.select(*_KEYS, "query_id", "pivot", "segment", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)).alias("apart"))
    least = F.greatest(F.lit(0.0), F.col("apart") - F.col("farthest") - _SLACK, F.col("nearest") - F.col("apart") - _SLACK)
    finite = F.col("apart").isNotNull() & ~F.isnan("apart") & (F.col("farthest") < float("inf"))
    return index.blocks.drop("center").join(near, [*_KEYS, "pivot", "segment"]).select(
        "query_id", "block", "rows", F.when(finite, least).otherwise(0.0).alias("least"))


def pruned_search(queries: DataFrame, index: ChunkIndex, k: int, query_rows: int = 512) -> tuple[DataFrame, DataFrame]:
    """(neighbours found, blocks still looked at in the second pass). The first pass searches the nearest blocks that hold k rows
    together; the k-th distance found there rules out every block whose bound lies beyond it."""
    bounds = settle(block_bounds(queries, index), "block-bounds")
    order = Window.partitionBy("query_id").orderBy("least", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bounds.withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    # written, so that Spark sees how few blocks they are: vectors of the others are not shuffled
    nearest = settle(ranked.filter(F.col("before") < k).select("query_id", "block"), "nearest-pairs")
    first = settle(_search(nearest, queries, index, k, query_rows), "nearest-blocks")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("semantic_distance"))
    limit = first.withColumn("n", nth).filter(F.col("n") == k).select("query_id", F.sqrt(2 * F.col("semantic_distance")).alias("limit"))
    later = ranked.filter(F.col("before") >= k).join(limit, "query_id", "left").filter(F.col("limit").isNull() | F.isnan("limit") | (F.col("least") <= F.col("limit")))
    later = settle(later.select("query_id", "block"), "open-blocks")
    return first.unionByName(_search(later, queries, index, k, query_rows)), later


def semantic_topk(queries: DataFrame, index: ChunkIndex, k: int = V.CANDIDATE_LIMIT, query_rows: int = 512) -> DataFrame:
    """(query_id, chunk_id, semantic_distance, semantic_similarity, semantic_rank), exact.

    `queries`: query_id, kb_id, embedding_model, embedding_dim, embedding, document_ids, languages.
    """
    best, _ = pruned_search(queries, index, k, query_rows)
    order = Window.partitionBy("query_id").orderBy(
        F.asc("semantic_distance"), F.desc("indexed_us"), F.asc("chunk_id")
    )
    return (
        best.withColumn("semantic_rank", F.row_number().over(order))
        .filter(F.col("semantic_rank") <= k)
        .select(
            "query_id", "chunk_id", "semantic_distance",
            (1 - F.col("semantic_distance")).alias("semantic_similarity"), "semantic_rank",
        )
    )
