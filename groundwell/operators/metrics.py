"""Counters, duration histograms and the operations snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V


def metric_key(name: Column, tags: Column) -> Column:
    """`name{a=1,b=2}` with tags sorted by key; a null value prints as null, no tags print the name alone."""
    entries = F.array_sort(F.map_entries(tags))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    tagged = F.concat(name, F.lit("{"), F.array_join(shown, ","), F.lit("}"))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, tagged).otherwise(name)


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows that count while they pass: the metrics are there when the job that reads them has run, without a second scan."""
    seen = Observation(name)
    return rows.observe(seen, *[metric.alias(label) for label, metric in metrics.items()]), seen


def counter_totals(samples: DataFrame) -> DataFrame:
    keyed = samples.withColumn("metric", metric_key(F.col("name"), F.col("tags")))
    return keyed.groupBy("metric").agg(F.sum("value").alias("total"))


def duration_histogram(samples: DataFrame, window: int = V.METRIC_WINDOW) -> DataFrame:
    """count, avg, p50, p95 and max per key over its last `window` valid samples.

    The limit per key is a window group limit, so each task forwards at most `window` rows of a key before
    the shuffle; the nearest-rank percentiles then work on at most `window` values per key.
    """
    valid = samples.filter(~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") != float("inf")))
    keyed = valid.select(metric_key(F.col("name"), F.col("tags")).alias("metric"), "value", "ts", "event_id")
    newest = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = keyed.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= window)
    stats = recent.groupBy("metric").agg(
        F.count("*").alias("count"), F.avg("value").alias("avg"), F.max("value").alias("max"),
        F.array_sort(F.collect_list("value")).alias("sorted"),
    )

    def nearest_rank(q: float) -> Column:
        spot = F.greatest(F.lit(1), F.ceil(F.size("sorted") * F.lit(q)).cast("int"))
        return F.round(F.element_at("sorted", spot), 2)

    return stats.select(
        "metric", "count", F.round("avg", 2).alias("avg"), nearest_rank(0.5).alias("p50"),
        nearest_rank(0.95).alias("p95"), F.round("max", 2).alias("max"),
    )


def stage_timings(timings: DataFrame) -> DataFrame:
    """Histogram of stage durations; `timings` is (event_id, ts, kb_id, stage, value)."""
    tagged = timings.withColumn("name", F.lit("stage_duration_ms")).withColumn(
        "tags", F.create_map(F.lit("kb_id"), "kb_id", F.lit("stage"), "stage")
    )
    return duration_histogram(tagged)


def indexed_chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kb_id").agg(F.count("*").alias("indexed_chunks"))


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """One row; an empty job table gives zeros."""
    status = F.col("status")
    return jobs.agg(
        F.count_if(status.isin("FAILED", "DEAD_LETTER")).alias("failed_jobs"),
        F.count_if(status == "WAITING").alias("waiting_jobs"),
        F.count_if(status == "ACTIVE").alias("active_jobs"),
        F.count_if(status == "COMPLETED").alias("completed_jobs"),
    )


def average_ingest_ms(versions: DataFrame) -> DataFrame:
    spent = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    return versions.agg(F.round(F.coalesce(F.avg(spent), F.lit(0.0)), 2).alias("average_duration_ms"))


def zero_hit_rate(summary: DataFrame) -> DataFrame:
    return summary.groupBy("kb_id").agg(
        F.count("*").alias("questions"), F.count_if(F.col("selected_chunks") == 0).alias("zero_hits"),
        F.round(F.avg((F.col("selected_chunks") == 0).cast("double")), 4).alias("zero_hit_rate"),
    )


def outcome_stats(requests: DataFrame, *keys: str) -> DataFrame:
    """Requests and total duration per key combination; `requests` has `duration_ms`."""
    return requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.round(F.sum("duration_ms"), 2).alias("total_ms"),
        F.round(F.max("duration_ms"), 2).alias("max_ms"),
    )


def token_usage(requests: DataFrame) -> DataFrame:
    return requests.groupBy("model", "request_type", "outcome").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def route_path(url: Column) -> Column:
    """Path of a URL without its query string."""
    return F.regexp_extract(F.split(url, r"\?")[0], r"^(?:[a-z]+://[^/?#]+)?([^#]*)", 1)


def ops_snapshot(jobs: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Job counts, mean ingestion time and the latest completed evaluation run, in one row.

    The three parts are single-row aggregates; they are unioned as one-key rows and folded, not crossed.
    """
    latest = runs.filter("status = 'COMPLETED'").agg(F.max_by("run_id", "started_at").alias("latest_run_id"))
    parts = (
        job_status_counts(jobs)
        .unionByName(average_ingest_ms(versions), allowMissingColumns=True)
        .unionByName(latest, allowMissingColumns=True)
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
