"""Numbers along a total order, without a task that sees the whole order or a whole group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.sources.tables import settle


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill `__before`, its last column, with the sum of `__w` over the rows of the task that came before."""
    total = 0
    for batch in batches:
        weight = batch.column("__w").to_numpy()
        sums = total + np.cumsum(weight)
        if len(sums):
            total = int(sums[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums - weight, pa.int64())], schema=batch.schema)


def range_parts(rows: DataFrame, rows_per_part: int = 500_000) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_per_part))


def numbered(ranged: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """running_total of rows that are already partitioned by range of the first columns of order: they are not shuffled again. What
    a task holds is sorted, summed and written; one running sum over the tasks (a row each) adds the rest."""
    weighted = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__w", weight.cast("long")).withColumn("__before", F.lit(0).cast("long"))
    summed = settle(weighted.sortWithinPartitions(*order).mapInArrow(_summed, weighted.schema), "ranges")
    held = summed.groupBy("__part").agg(F.sum("__w").alias("__held"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark sees how small it is and shuffles no row of the other side
    offsets = settle(held.select("__part", F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__offset")), "offsets")
    return (
        summed.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__offset"))
        .drop("__w", "__part", "__offset", "__before")
    )


def running_total(rows: DataFrame, order: list[str], weight: Column, name: str = "before", rows_per_part: int = 500_000) -> DataFrame:
    """rows with `name`: the sum of weight over all rows that stand before, in order of the columns given. Rows are sorted by
    range and written; each range sums what it holds, and one running sum over the ranges (a row each) adds the rest."""
    return numbered(rows.repartitionByRange(range_parts(rows, rows_per_part), *order), order, weight, name)
