"""T, S12, U04: streams over the given tables, drained and read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from groundwell.conformance.entity_queries import _JOB_FOLD
from groundwell.conformance.ingest_queries import OVERLAP, TARGET, styled_text
from groundwell.conformance.ingest_queries import VIEWS as _CHUNKS
from groundwell.conformance.registry import query
from groundwell.sources.tables import shared_dir
from groundwell.streaming import jobs as J


def event_stream(c):
    kind = (
        F.when(F.col("event_type").isin("signup", "view"), "start").when(F.col("event_type") == "click", "success")
        .when(F.col("event_type") == "error", "retryable_failure").otherwise("terminal_failure")
    )
    return J.table_stream(c.spark, c.directory, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"),
        F.col("event_type").alias("name"), "value")


@query("s12_job_stream", "SELECT event, count(*) AS messages FROM v_job_event GROUP BY event")
def _(c):
    out = J.drain(event_stream(c).select("event_id", "event"), shared_dir(c.spark, "jobs"))
    return out.groupBy("event").agg(F.count("*").alias("messages"))


@query("t01_stream_ingest", "SELECT doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunk GROUP BY doc_id", _CHUNKS)
def _(c):
    root = shared_dir(c.spark, "ingest")
    docs = J.table_stream(c.spark, c.directory, "documents").select(
        "doc_id", F.col("doc_id").alias("version_id"), styled_text(F.col("text")).alias("text"))
    J.stream_ingest(docs, root, TARGET, OVERLAP)
    return J.stored_chunks(c.spark, root).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def job_changes(c, label, done=J.idle, **options):
    root = shared_dir(c.spark, label)
    return J.run_until(J.job_state_stream(event_stream(c), **options), root, done), root


@query("t02_job_state_stream", """
    SELECT job_id, s.status AS status, s.attempts::BIGINT AS attempts, s.at AS changed_us FROM job_fold""", _JOB_FOLD)
def _(c):
    changes, _ = job_changes(c, "state")
    return J.latest(changes, "job_id").select("job_id", "status", F.col("attempts").cast("long"), "changed_us")


#: jobs of four events each, of which some are left waiting for a retry
_SHORT_JOBS = {
    "v_short_job_event": "SELECT event_id // 4 AS job_id, event_id, ts, event FROM v_job_event",
    "short_job_fold": _JOB_FOLD["job_fold"].replace("v_job_event", "v_short_job_event"),
}


@query("t03_retry_timer", """
    SELECT job_id, s.attempts::BIGINT AS attempts, s.at AS changed_us FROM short_job_fold WHERE s.status = 'WAITING' AND s.attempts > 0""", _SHORT_JOBS)
def _(c):
    # the clock runs faster than in production, so that the query ends; delays still double with every attempt
    root = shared_dir(c.spark, "retry")
    events = event_stream(c).withColumn("job_id", F.floor(F.col("event_id") / 4))
    stream = J.job_state_stream(events, backoff_ms=200)

    def all_emitted(query):
        return J.idle(query) and J.waiting(c.spark.read.parquet(f"{root}/out")).isEmpty()

    changes = J.run_until(stream, root, all_emitted)
    return J.due_retries(changes).select("job_id", F.col("attempts").cast("long"), "changed_us")


@query("t04_completed_job_expiry", """
    SELECT job_id, s.status IN ('COMPLETED', 'FAILED', 'DEAD_LETTER') AS finished, s.status NOT IN ('COMPLETED', 'FAILED', 'DEAD_LETTER') AS kept
    FROM job_fold""", _JOB_FOLD)
def _(c):
    # entries are kept for a second here, so that all of them have expired when the state is read
    changes, root = job_changes(c, "expiry", completed_s=1, failed_s=1)
    time.sleep(1.5)
    return J.kept_entries(c.spark, root)


@query("t05_exactly_once_jobs", "SELECT event_id FROM events")
def _(c):
    once = event_stream(c).select("event_id", "ts")
    twice = once.unionByName(event_stream(c).select("event_id", "ts"))
    return J.distinct_jobs(twice, shared_dir(c.spark, "once"), "event_id").select("event_id")


@query("t06_metrics_stream", """
    SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type AS name, count(*) AS count, round(sum(value), 4) AS total, max(value) AS max
    FROM events GROUP BY 1, 2""")
def _(c):
    out = J.drain(J.metrics_stream(event_stream(c)), shared_dir(c.spark, "metrics"), "update")
    return J.latest(out, "window_us", "name").withColumn("total", F.round("total", 4))


@query("u04_metric_sink", "SELECT event_type AS name, count(*) AS events FROM events GROUP BY 1")
def _(c):
    root = shared_dir(c.spark, "sink")

    def emit(batch, batch_id):
        batch.groupBy("name").agg(F.count("*").alias("events")).write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    J.metric_sink(event_stream(c), root, emit)
    return c.spark.read.parquet(f"{root}/out").groupBy("name").agg(F.sum("events").alias("events"))
