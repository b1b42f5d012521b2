"""Streams over several batches: late events, finished jobs, emitted retries, expiry, repeats, replays, versions."""

import time
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

import pytest

from groundwell.plans import ingest
from groundwell.sources.tables import shared_dir
from groundwell.streaming import jobs as J

SCHEMA = "job_id long, event_id long, ts timestamp, event string"


def run(spark, batches, root=None, done=J.idle, pause=0.0, **options):
    root = root or shared_dir(spark, "stream-test")
    for rows in batches:  # a file a batch, run one after the other with one state
        if rows:
            spark.createDataFrame(rows, "job_id long, event_id long, ts string, event string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        out = J.run_until(J.job_state_stream(stream, **options), f"{root}/run", done)
        time.sleep(pause)
    return out, f"{root}/run"


def test_late_events_count_and_finished_jobs_stay_finished(spark):
    out, _ = run(spark, [
        [(1, 1, "2024-01-01 10:00:00", "start"), (1, 2, "2024-01-01 10:00:05", "success")],
        [(2, 3, "2024-01-01 15:00:00", "start")],
        [(3, 4, "2024-01-01 06:00:00", "start"), (1, 5, "2024-01-01 18:00:00", "start")],
    ])
    last = {r["job_id"]: (r["status"], r["attempts"]) for r in J.latest(out, "job_id").collect()}
    assert last == {1: ("COMPLETED", 1), 2: ("ACTIVE", 1), 3: ("ACTIVE", 1)}
    done = out.filter("job_id = 1 AND status = 'COMPLETED'").first()
    assert done["expires_us"] == done["changed_us"] + J.COMPLETED_KEPT_S * 1_000_000


def test_a_retry_is_emitted_once_after_its_delay_and_not_if_overtaken(spark):
    root = shared_dir(spark, "retry-test")
    fail = [(7, 1, "2024-01-01 10:00:00", "start"), (7, 2, "2024-01-01 10:00:01", "retryable_failure"), (8, 3, "2024-01-01 10:00:02", "start")]
    slow = [(9, 4, "2024-01-01 10:00:00", "start"), (9, 5, "2024-01-01 10:00:01", "retryable_failure"), (9, 6, "2024-01-01 10:00:02", "start"), (9, 7, "2024-01-01 10:00:03", "retryable_failure")]

    def emitted(query):
        return J.idle(query) and J.waiting(spark.read.parquet(f"{root}/run/out")).isEmpty()

    out, _ = run(spark, [fail + slow], root, emitted, backoff_ms=300)
    retries = out.filter("kind = 'retry'").collect()
    assert sorted((r["job_id"], r["attempts"]) for r in retries) == [(7, 1), (9, 2)]
    again, _ = run(spark, [[(7, 8, "2024-01-01 10:00:20", "start"), (7, 9, "2024-01-01 10:00:21", "success")]], root, J.idle, backoff_ms=300)
    assert [(r["job_id"]) for r in J.due_retries(again).collect()] == [9]
    last = {r["job_id"]: (r["status"], r["attempts"]) for r in J.latest(again, "job_id").collect()}
    assert last == {7: ("COMPLETED", 2), 8: ("ACTIVE", 1), 9: ("WAITING", 2)}


def test_a_start_before_the_delay_is_over_cancels_the_retry(spark):
    root = shared_dir(spark, "cancel-test")
    run(spark, [[(1, 1, "2024-01-01 10:00:00", "start"), (1, 2, "2024-01-01 10:00:01", "retryable_failure")]], root, backoff_ms=60_000)
    out, _ = run(spark, [[(1, 3, "2024-01-01 10:00:02", "start")]], root, backoff_ms=60_000)
    assert J.waiting(out).isEmpty() and out.filter("kind = 'retry'").isEmpty()


def test_entries_of_finished_jobs_fall_away_and_their_mark_stays(spark):
    root = shared_dir(spark, "expiry-test")
    rows = [(1, 1, "2024-01-01 10:00:00", "start"), (1, 2, "2024-01-01 10:00:05", "success"), (2, 3, "2024-01-01 10:00:00", "start"), (2, 4, "2024-01-01 10:00:01", "terminal_failure"), (3, 5, "2024-01-01 10:00:00", "start")]
    _, run_root = run(spark, [rows], root, completed_s=1, failed_s=3600, pause=1.2)
    assert {tuple(r) for r in J.kept_entries(spark, run_root).collect()} == {(1, False, True), (2, True, True), (3, True, False)}
    out, _ = run(spark, [[(1, 6, "2024-01-02 10:00:00", "start")]], root, completed_s=1, failed_s=3600)
    assert {r["job_id"]: r["status"] for r in J.latest(out, "job_id").collect()}[1] == "COMPLETED"
    assert (1, False, True) in {tuple(r) for r in J.kept_entries(spark, run_root).collect()}


def test_a_job_of_any_lateness_comes_out_once_and_a_replay_adds_nothing(spark):
    root = shared_dir(spark, "once-test")
    batches = [[(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 16:00:00")], [(3, "2024-01-01 04:00:00"), (2, "2024-01-01 16:00:00")], [(1, "2024-01-03 10:00:00"), (4, "2023-01-01 10:00:00")]]
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{root}/in")
        out = J.distinct_jobs(stream, f"{root}/run", "event_id", buckets=3)
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 4]
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run/state/commits/2")
    commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, False)  # as if the driver was lost before the commit
    out = J.distinct_jobs(stream, f"{root}/run", "event_id", buckets=3)
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 4]


def test_versions_of_one_document_stay_apart_and_the_newest_batch_of_a_version_counts(spark):
    root = shared_dir(spark, "version-test")
    def text(word):
        return f"The {word} worker restarts after the nightly backup has finished.\n\nOperators of the {word} queue watch its depth and its age."

    batches = [[(1, 11, text("first")), (1, 12, text("second")), (2, 21, text("kept"))], [(1, 12, text("third")), (2, 22, text("other"))], [(2, 22, "")]]
    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, version_id long, text string").coalesce(1).write.mode("append").parquet(f"{root}/in")
        J.stream_ingest(spark.readStream.schema("doc_id long, version_id long, text string").parquet(f"{root}/in"), f"{root}/run")
    got = {r["version_id"]: (r["doc_id"], r["content"]) for r in J.stored_chunks(spark, f"{root}/run").collect()}
    docs = spark.createDataFrame([(11, text("first")), (12, text("third")), (21, text("kept"))], "doc_id long, text string")
    want = {r["doc_id"]: (r["doc_id"] // 10, r["content"]) for r in ingest.ingest_documents(docs).collect()}
    assert got == want and len(want) == 3
    stored = spark.read.parquet(f"{root}/run/chunks").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.sum(F.length("content")).alias("l"))
    kept = {r["batch_id"]: (r["chunks"], r["tokens"], r["characters"]) for r in J.ingest_metrics(spark, f"{root}/run").collect()}
    assert kept == {r["batch_id"]: (r["n"], r["t"], r["l"]) for r in stored.collect()} | {2: (0, 0, 0)}


def test_a_table_in_a_folder_of_files_is_streamed_like_one_in_a_single_file(spark):
    rows = spark.createDataFrame([(i, f"Text number {i}.", "en", "src1", 10) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    root = shared_dir(spark, "table")
    out = shared_dir(spark, "table-out")
    rows.repartition(3).write.parquet(f"{root}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"{root}/made")
    part = next(Path(f"{root}/made").glob("*.parquet"))
    Path(f"{root}/file").mkdir()
    (Path(f"{root}/file") / "documents.parquet").write_bytes(part.read_bytes())
    for kind in ("folder", "file"):
        stream = J.table_stream(spark, f"{root}/{kind}", "documents", files_per_trigger=2)
        assert sorted(r["doc_id"] for r in J.drain(stream, f"{out}/{kind}").collect()) == [*range(6)]


def test_the_first_batch_after_a_restart_does_not_make_a_query_idle():
    def query(*rows):
        return SimpleNamespace(recentProgress=[{"numInputRows": n} for n in rows])

    assert not J.idle(query(0)) and not J.idle(query(0, 2)) and not J.idle(query(2))
    assert J.idle(query(0, 2, 0)) and J.idle(query(2, 0)) and J.idle(query(0, 0))


def test_a_stream_at_work_is_not_ended_and_one_without_work_is(spark):
    root = shared_dir(spark, "limit-test")
    rows = [(i, 2 * i + n, f"2024-01-01 10:00:0{n}", ("start", "retryable_failure")[n]) for i in range(8) for n in range(2)]
    frame = spark.createDataFrame(rows, "job_id long, event_id long, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    frame.repartitionByRange(8, "job_id").write.parquet(f"{root}/in")
    stream = J.job_state_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), backoff_ms=100)

    def emitted(query):
        return J.idle(query) and J.waiting(spark.read.parquet(f"{root}/run/out")).isEmpty()

    out = J.run_until(stream, f"{root}/run", emitted, limit_s=3)  # eight batches, begun a second apart at least
    assert out.select("batch_id").distinct().count() >= 8
    assert sorted(r["job_id"] for r in J.due_retries(out).collect()) == [*range(8)]
    with pytest.raises(TimeoutError):
        J.run_until(stream, f"{root}/other", lambda query: False, limit_s=3)


def test_jobs_of_one_bucket_share_their_state_and_keep_apart(spark):
    root, moves = shared_dir(spark, "bucket-test"), {0: ["start", "retryable_failure"], 1: ["start", "success"], 2: ["start", "terminal_failure"], 3: ["start"], 4: ["success"]}
    first = [(job, 10 * job + n, f"2024-01-01 10:00:0{n}", event) for job in range(200) for n, event in enumerate(moves[job % 5])]

    def emitted(query):
        return J.idle(query) and J.waiting(spark.read.parquet(f"{root}/run/out")).isEmpty()

    out, run_root = run(spark, [[*first, (None, 5000, "2024-01-01 10:00:00", "start")]], root, emitted, backoff_ms=300, buckets=8)
    want = {job: [("WAITING", 1), ("COMPLETED", 1), ("FAILED", 1), ("ACTIVE", 1), ("WAITING", 0)][job % 5] for job in range(200)} | {None: ("ACTIVE", 1)}
    assert {r["job_id"]: (r["status"], r["attempts"]) for r in J.latest(out, "job_id").collect()} == want
    assert sorted(r["job_id"] for r in J.due_retries(out).collect()) == [*range(0, 200, 5)]
    entries = spark.read.format("statestore").option("path", f"{run_root}/state").option("stateVarName", "live").load()
    assert 1 <= entries.count() <= 8
    second = [(job, 9000 + job, "2024-01-01 11:00:00", "start") for job in range(0, 200, 2)]
    again, _ = run(spark, [second], root, backoff_ms=300, buckets=8)
    touched = {job: ("ACTIVE", n + 1) if status in ("WAITING", "ACTIVE") else (status, n) for job, (status, n) in want.items() if job is not None and job % 2 == 0}
    assert {r["job_id"]: (r["status"], r["attempts"]) for r in J.latest(again, "job_id").collect()} == want | touched
    kept = {r["job_id"]: (r["kept"], r["finished"]) for r in J.kept_entries(spark, run_root).collect()}
    assert kept == {job: (True, status in ("COMPLETED", "FAILED")) for job, (status, _) in (want | touched).items()}


def test_a_query_stops_between_batches_and_goes_on_where_it_was(spark):
    root = shared_dir(spark, "stop-test")
    frame = spark.createDataFrame([(i, i, "2024-01-01 10:00:00", "start") for i in range(6)], "job_id long, event_id long, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    frame.repartitionByRange(6, "job_id").write.parquet(f"{root}/in")
    stream = J.job_state_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    first = J.run_until(stream, f"{root}/run", lambda query: len(query.recentProgress) == 1, every="0 seconds")
    seen = first.count()
    assert 1 <= seen < 6
    out = J.run_until(stream, f"{root}/run", J.idle)
    assert sorted(r["job_id"] for r in out.collect()) == [*range(6)]
