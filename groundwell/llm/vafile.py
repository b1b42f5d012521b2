"""Centroid clustering over a vector approximation file: few-bit cells bound the distances, vectors are read where bounds overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, hash_sample, settle

#: larger components are cut to this, so that every squared distance of 64 components fits into 64 bits
LARGEST = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(table: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """Rows of table(vec_id, embedding) with exactly `dims` components, none null or non-finite: vec_id, vector array<long>,
    each component floor(scale * x), x as double, and at most 2^27 from zero."""
    whole = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def integer(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))).cast("long")

    return table.filter(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", integer).alias("vector"))


class Cells:
    """Cells of every dimension: `inner` (dims, cells - 1) holds the first value of each cell but the lowest; low and high are
    the least and greatest value of all vectors, so the outer cells are bounded too."""

    def __init__(self, inner: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.inner = np.clip(inner, low[:, None], high[:, None])
        self.first = np.concatenate([low[:, None], self.inner], axis=1)
        # an empty cell, between two equal cuts, is never looked up
        self.last = np.maximum(np.concatenate([self.inner - 1, high[:, None]], axis=1), self.first)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.inner[d], vectors[:, d], "right") for d in range(vectors.shape[1])], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(dims, cells, 2 k): least and greatest squared distance from a value of the cell to each centroid's component."""
        c = centroids.T[:, None, :]
        under, over = self.first[:, :, None] - c, c - self.last[:, :, None]
        nearest = np.maximum(np.maximum(under, over), 0)
        farthest = np.maximum(np.abs(under), np.abs(over))
        return np.concatenate([nearest**2, farthest**2], axis=2)


def assign(cells: np.ndarray, tables: np.ndarray, centroids: np.ndarray, fetch) -> tuple[np.ndarray, int]:
    """Nearest centroid of each row of cells, the smaller number on ties, and for how many rows the vector was needed.

    A centroid whose least distance exceeds another's greatest is out. Where one is left it is the nearest; for all other
    rows `fetch(rows)` gives the vectors, which are compared with the centroids left."""
    k = len(centroids)
    bounds = np.zeros((len(cells), 2 * k), np.int64)
    for d in range(cells.shape[1]):
        bounds += tables[d][cells[:, d]]
    left = bounds[:, :k] <= bounds[:, k:].min(axis=1, keepdims=True)
    nearest = left.argmax(axis=1).astype(np.int32)
    open_rows = np.flatnonzero(left.sum(axis=1) > 1)
    if len(open_rows):
        row, centroid = np.nonzero(left[open_rows])
        distance = np.full((len(open_rows), k), np.iinfo(np.int64).max)
        distance[row, centroid] = ((fetch(open_rows)[row] - centroids[centroid]) ** 2).sum(axis=1)
        nearest[open_rows] = distance.argmin(axis=1)
    return nearest, len(open_rows)


def _cells_of(column: pa.Array, dims: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(column), -1)[:, :dims]


def _vectors_of(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    if rows is not None:
        column = column.take(pa.array(rows))
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _span(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension; a task sends one pair a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in _pieces(batches):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if len(flat):
                low, high = np.minimum(low, flat.min(axis=0)), np.maximum(high, flat.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = vectors.select("vector").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(ends.collect())  # one row a dimension
    return np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64)


def approximation_file(vectors: DataFrame, dims: int, sample: int) -> tuple[DataFrame, Cells]:
    """A written table (vec_id, cells, vector) of vectors(vec_id, vector): four bits a dimension, and the whole vector as
    32-bit numbers; and the cells. Cuts are quantiles of the `sample` vectors of smallest hash; the outer bounds are exact."""
    low, high = _span(vectors, dims)
    drawn = np.array([r["vector"] for r in hash_sample(vectors, sample, "vec_id", "vector").collect()], np.int64)
    cuts = np.quantile(drawn, np.arange(1, 16) / 16, axis=0, method="higher").T.astype(np.int64)
    cells = Cells(cuts, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            found = cells.encode(flat)
            found = np.pad(found, ((0, 0), (0, found.shape[1] % 2)))
            packed, whole = found[:, ::2] << 4 | found[:, 1::2], flat.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "cells", "vector"])

    return settle(vectors.mapInArrow(run, "vec_id long, cells binary, vector binary"), "vafile"), cells


def _sums(stored: DataFrame, cells: Cells, centroids: np.ndarray) -> dict[int, tuple[np.ndarray, int]]:
    """Sum and count of the vectors of each cluster. A task sends one row a cluster."""
    k, dims = centroids.shape
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in _pieces(batches):
            vectors = batch.column(1)
            nearest, _ = assign(_cells_of(batch.column(0), dims), tables, centroids, lambda rows, v=vectors: _vectors_of(v, rows))
            order = np.argsort(nearest, kind="stable")
            present, first, size = np.unique(nearest[order], return_index=True, return_counts=True)
            if len(present):
                sums[present] += np.add.reduceat(_vectors_of(vectors)[order], first, axis=0)
                counts[present] += size
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full].tolist(), pa.list_(pa.int64())), pa.array(counts[full], pa.int64())], ["cluster", "total", "n"])

    parts = stored.select("cells", "vector").mapInArrow(run, "cluster int, total array<long>, n long")
    added = (
        parts.select("cluster", "n", F.posexplode("total").alias("d", "part")).groupBy("cluster", "d")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    )
    out = {}
    for r in sorted(added.collect(), key=lambda r: r["d"]):  # one row a cluster and dimension
        out.setdefault(r["cluster"], ([], r["n"]))[0].append(int(r["total"]))
    return out


def cluster_vectors(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, sample: int = 4096) -> DataFrame:
    """One row per kept vector of table(vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256, as after `rounds` rounds of Lloyd's algorithm over integer vectors.

    Kept are the rows of `kept_vectors`; every row counts, also one that repeats a vec_id. The first centroids are the k
    kept vectors of smallest sha256 of "1:<vec_id>", equal hashes in order of the vector, a null vec_id last; with fewer
    vectors there are fewer centroids, with none no rows. Other columns are ignored.

    Every round is one scan of the approximation file. Cells, four bits a dimension, and one look-up table a dimension
    give an interval of the distance to each centroid; whole vectors are compared only where intervals overlap. The sums of the
    clusters are exact integers. Nothing grows on the driver: k centroids, the cells, and `sample` vectors for the cuts, on
    which no result depends.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = kept_vectors(table, dims, scale)
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(name.asc_nulls_last(), "vector").limit(k).collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    stored, cells = approximation_file(vectors, dims, sample)
    centroids = np.array([r["vector"] for r in start], np.int64)
    for _ in range(rounds):
        for cluster, (total, n) in _sums(stored, cells, centroids).items():
            centroids[cluster] = [t // n for t in total]  # exact, towards minus infinity
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            vectors = batch.column(2)
            nearest, _ = assign(_cells_of(batch.column(1), dims), tables, centroids, lambda rows, v=vectors: _vectors_of(v, rows))
            distance = ((_vectors_of(vectors) - centroids[nearest]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    last = settle(stored.mapInArrow(run, "vec_id long, cluster int, distance long"), "vafile-clusters")
    inertia = {r["cluster"]: int(r["total"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1).cast(kind)

    return last.select(
        "vec_id", "cluster", "distance", of_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"),
    )


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same in DuckDB; one pair of common table expressions a round."""
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, vec FROM v QUALIFY c < {k})",
    ]
    near = """SELECT vec_id, any_value(v.vec) AS vec, arg_min({{'c': c.c, 'd': d}}, (d, c.c)) AS best FROM
        (SELECT v.vec_id, v.vec, c{r}.c, list_sum(list_transform(range(1, {n}), lambda i: (v.vec[i] - c{r}.vec[i]) * (v.vec[i] - c{r}.vec[i]))) AS d FROM v, c{r}) AS v
        JOIN (SELECT c FROM c{r}) AS c ON v.c = c.c GROUP BY vec_id"""
    for r in range(rounds + 1):
        steps.append(f"a{r} AS ({near.format(r=r, n=dims + 1)})")
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT best.c AS c, i, CAST(sum(vec[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL),
                m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS vec FROM s{r} GROUP BY c),
                c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.vec, c{r}.vec) AS vec FROM c{r} LEFT JOIN m{r} USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e.vec, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} AS e ON e.c = best.c"""


ORACLE = _oracle()
