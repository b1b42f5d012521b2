"""Streams: job messages, the job state machine with retries and expiry, metrics, and document ingestion.

Every stream keeps its checkpoint and its output below one shared folder, names output by batch id so that a
repeated batch overwrites itself, and bounds a batch by `maxFilesPerTrigger`.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from threading import Event, Lock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from groundwell.functions import fixed_values as V
from groundwell.operators import metrics
from groundwell.plans import ingest
from groundwell.sources.tables import TABLE_SCHEMAS

COMPLETED_KEPT_S = 3600
FAILED_KEPT_S = 86400
#: a batch reads the state of the buckets that its jobs fall into
JOB_BUCKETS = 1 << 14
#: state variables with timers and a time to live need this store
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with(schema: StructType, *numbers: str) -> StructType:
    """A schema and the integer columns that folders add."""
    return StructType([*schema.fields, *[StructField(n, IntegerType()) for n in numbers]])


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The files of a table as a stream, under its declared schema. A table is one file, several files of its name, or a folder of files."""
    return (
        spark.readStream.schema(TABLE_SCHEMAS[name]).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{directory}/{name}*.parquet")
    )


def drain(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output with `batch_id`, the batch that wrote a row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(_with(stream.schema, "batch_id")).parquet(f"{root}/out")


def _worked(batch: dict) -> bool:
    """Whether a finished batch took in rows or changed state, as timers that fire do."""
    return batch["numInputRows"] > 0 or any(o["numRowsUpdated"] or o["numRowsRemoved"] for o in batch["stateOperators"])


def run_until(stream: DataFrame, root: str, done: Callable[[StreamingQuery], bool], every: str = "1 second", limit_s: float = 300.0) -> DataFrame:
    """Run a stream that has timers until `done(query)` holds, and return its output with `batch_id`. Timers of the clock
    keep asking for batches, so such a query does not end by itself: whoever runs it says when. A query that has nothing to do for
    `limit_s` fails; one that is still at work does not, however long its batches take. No batch is written while `done` is asked, so
    it sees whole batches, and must not wait for one. The query is stopped between two batches, since Spark ends an executor whose
    stateful task is killed; a batch that was planned by then runs when the query goes on."""
    spark = stream.sparkSession
    writing, stopped = Lock(), Event()

    def write(batch: DataFrame, batch_id: int) -> None:
        with writing:
            if stopped.is_set():  # an error, so that the batch does not count as done
                raise InterruptedError(f"the query was stopped before batch {batch_id}")
            batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    def finished() -> bool:
        with writing:
            if done(query):
                stopped.set()
        return stopped.is_set()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
            .trigger(processingTime=every).foreachBatch(write).start()
        )
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    ends, worked, ended = time.monotonic() + limit_s, [], []
    try:
        while not finished():
            if query.exception() is not None:
                raise query.exception()
            times = [(p["timestamp"], _worked(p)) for p in query.recentProgress]
            if worked != (worked := [t for t, work in times if work][-1:]):
                ends = time.monotonic() + limit_s
            # what a running batch does shows when it ends
            if ended != (ended := times[-1:]) or not query.status["isTriggerActive"]:
                if time.monotonic() > ends:
                    raise TimeoutError(f"the stream was not done after {limit_s} s without work")
            time.sleep(0.2)
    finally:
        with writing:
            stopped.set()
        query.stop()
    return spark.read.schema(_with(stream.schema, "batch_id")).parquet(f"{root}/out")


def idle(query: StreamingQuery) -> bool:
    """Whether a finished batch found nothing new. The first batch of a query that goes on from a checkpoint does not tell: it may be
    one that was planned before the query was stopped, and looks at no newer input."""
    return any(p["numInputRows"] == 0 for p in query.recentProgress[1:])


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the newest batch per key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "batch_id")


_CHANGE = "job_id bigint, kind string, status string, attempts int, changed_us bigint, retry_at_us bigint, expires_us bigint"


def _transition(status: str, attempts: int, event: str, max_attempts: int) -> tuple[str, int] | None:
    """Next (status, attempts), or None when the event changes nothing."""
    if status in V.JOB_TERMINAL:
        return None
    if event == "start":
        return "ACTIVE", attempts + 1
    if status != "ACTIVE":
        return None
    if event == "retryable_failure":
        return ("DEAD_LETTER" if attempts >= max_attempts else "WAITING"), attempts
    return ("COMPLETED" if event == "success" else "FAILED"), attempts


_ENTRY = "job_id array<bigint>, status array<string>, attempts array<int>, changed_us array<bigint>"


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows)))


class JobMachine(StatefulProcessor):
    """State of the jobs of one bucket: their live entries while they run, the queue entries of finished ones for as long as they are
    kept, and marks that they are finished, for good. Every call for state is a round trip to the JVM, so a bucket's
    jobs are read and written together, a list a column."""

    def __init__(self, max_attempts: int, backoff_ms: int, completed_ms: int, failed_ms: int):
        self.max_attempts, self.backoff_ms = max_attempts, backoff_ms
        self.kept_ms = {"COMPLETED": completed_ms, "FAILED": failed_ms, "DEAD_LETTER": failed_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", _ENTRY + ", due_ms array<bigint>")
        # entries fall away by themselves, those of a batch together; completed and failed ones are kept for different times
        self.completed = handle.getListState("completed", _ENTRY, self.kept_ms["COMPLETED"])
        self.failed = handle.getListState("failed", _ENTRY, self.kept_ms["FAILED"])
        self.finished = handle.getValueState("finished", "job_id array<bigint>")

    def _row(self, job: int, kind: str, status: str, attempts: int, changed: int, wait_ms: int = 0) -> Row:
        kept = self.kept_ms.get(status, 0)
        return Row(
            job_id=job, kind=kind, status=status, attempts=attempts, changed_us=changed,
            retry_at_us=changed + wait_ms * 1000 if wait_ms else 0, expires_us=changed + kept * 1000 if kept else 0,
        )

    def _alive(self) -> dict[int, tuple[str, int, int, int]]:
        """(status, attempts, changed, due) of the live jobs."""
        return {job: tuple(entry) for job, *entry in zip(*(self.live.get() or ()))}

    def _keep(self, alive: dict[int, tuple[str, int, int, int]]) -> None:
        if alive:
            self.live.update(_columns([(job, *entry) for job, entry in alive.items()]))
        else:
            self.live.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = defaultdict(list)  # a bucket's events of one micro-batch, which the files per trigger bound
        for r in rows:
            events[r["job_id"]].append((r["ts_us"], r["event_id"], r["event"]))
        marks = (self.finished.get() or ([],))[0]
        for job in events.keys() & set(marks):
            del events[job]
        if not events:
            return
        alive, ended = self._alive(), []
        set_before = {due for *_, due in alive.values() if due}
        for job, happened in events.items():
            status, attempts, changed, _ = alive.pop(job, ("WAITING", 0, 0, 0))
            for at, _, event in sorted(happened):
                moved = _transition(status, attempts, event, self.max_attempts)
                if moved is not None:
                    (status, attempts), changed = moved, int(at)
            if status in V.JOB_TERMINAL:
                ended.append((job, status, attempts, changed))
                yield self._row(job, "state", status, attempts, changed)
                continue
            wait_ms = self.backoff_ms * 2 ** max(0, attempts - 1) if status == "WAITING" and attempts else 0
            alive[job] = status, attempts, changed, timerValues.getCurrentProcessingTimeInMs() + wait_ms if wait_ms else 0
            yield self._row(job, "state", status, attempts, changed, wait_ms)
        # jobs that are due at one time share a timer
        set_now = {due for *_, due in alive.values() if due}
        for due in set_before - set_now:
            self.handle.deleteTimer(due)
        for due in set_now - set_before:
            self.handle.registerTimer(due)
        self._keep(alive)
        for entries, kept in ((self.completed, [e for e in ended if e[1] == "COMPLETED"]), (self.failed, [e for e in ended if e[1] != "COMPLETED"])):
            if kept:
                entries.appendValue(_columns(kept))
        if ended:
            self.finished.update(([*marks, *(job for job, *_ in ended)],))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        alive, at = self._alive(), expiredTimerInfo.getExpiryTimeInMs()
        fired = [job for job, (status, _, _, due) in alive.items() if status == "WAITING" and due == at]
        if not fired:
            return
        for job in fired:
            status, attempts, changed, _ = alive[job]
            alive[job] = status, attempts, changed, 0
            yield self._row(job, "retry", status, attempts, changed)
        self._keep(alive)

    def close(self) -> None:
        pass


def job_state_stream(
    events: DataFrame, max_attempts: int = V.JOB_MAX_ATTEMPTS, backoff_ms: int = V.JOB_BACKOFF_MS,
    completed_s: float = COMPLETED_KEPT_S, failed_s: float = FAILED_KEPT_S, buckets: int = JOB_BUCKETS,
) -> DataFrame:
    """Changes of jobs, from a stream of (job_id, event_id, ts, event).

    A row of kind `state` is the state of a job after a batch that touched it. A row of kind `retry` is the job put to work again:
    a waiting job sets a timer of the clock for its delay, which doubles with every attempt, and is emitted when it fires.
    Every event counts, however late: no watermark drops it. The queue entry of a completed job is kept for an hour, that of a
    failed one for a day, then it falls out of the state; its id stays as a mark, so a later start cannot revive the job.
    Jobs are dealt into buckets by a hash of their id, and the state of a bucket is one entry of the state store.
    Needs the RocksDB state store and, because of the timers, `run_until`.
    """
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")
    timed = events.select(bucket, "job_id", "event_id", "event", F.unix_micros("ts").alias("ts_us"))
    machine = JobMachine(max_attempts, backoff_ms, int(completed_s * 1000), int(failed_s * 1000))
    return timed.groupBy("bucket").transformWithState(
        statefulProcessor=machine, outputStructType=_CHANGE, outputMode="Update", timeMode="ProcessingTime")


def due_retries(changes: DataFrame) -> DataFrame:
    """Of all changes (with batch_id), the retries that were emitted and that no later event has overtaken."""
    return latest(changes, "job_id").filter("kind = 'retry'")


def waiting(changes: DataFrame) -> DataFrame:
    """Jobs whose retry has not been emitted yet."""
    return latest(changes, "job_id").filter("kind = 'state' AND status = 'WAITING' AND attempts > 0")


def kept_entries(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, finished, kept) from the newest state: whether a job is marked finished, and whether it has a queue entry now."""
    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", name).load()

    def entries(name: str) -> DataFrame:
        # the store drops an expired value when it next cleans up; until then its time tells
        fresh = F.col("list_element.ttlExpirationMs") > F.unix_millis(F.current_timestamp())
        return variable(name).filter(fresh).select(F.explode("list_element.value.job_id").alias("job_id"), F.lit(True).alias("kept"))

    alive = variable("live").select(F.explode("value.job_id").alias("job_id"), F.lit(True).alias("kept"), F.lit(False).alias("finished"))
    marked = variable("finished").select(F.explode("value.job_id").alias("job_id"), F.lit(True).alias("finished"))
    ended = marked.join(entries("completed").unionByName(entries("failed")), "job_id", "left").select("job_id", F.coalesce("kept", F.lit(False)).alias("kept"), "finished")
    return alive.unionByName(ended)


def distinct_jobs(messages: DataFrame, root: str, key: str, buckets: int = 64) -> DataFrame:
    """Each job once, however late a repeat comes, and however often a batch is replayed.

    What was given out is the table of keys: a folder per batch, dealt into buckets by key. A batch keeps the first message of each key
    and leaves out keys of earlier batches, bucket by bucket, reading only the key column. It replaces its own folder, so
    one write commits both the messages and their keys.
    """
    spark = messages.sparkSession
    schema = _with(messages.schema, "batch_id", "bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        first = batch.dropDuplicates([key]).withColumn("bucket", bucket)
        if batch_id:
            given = spark.read.schema(schema).parquet(f"{root}/out").filter(F.col("batch_id") < batch_id)
            first = first.join(given.select("bucket", key), ["bucket", key], "left_anti")
        first.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/out/batch_id={batch_id}")

    query = (
        messages.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").drop("bucket", "batch_id")


def metrics_stream(samples: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, sums and maxima per metric and tumbling window. A sample later than the watermark delay is dropped: a window that
    was closed is not opened again."""
    return (
        samples.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "name")
        .agg(F.count("*").alias("count"), F.sum("value").alias("total"), F.max("value").alias("max"))
        .select(F.unix_micros("w.start").alias("window_us"), "name", "count", "total", "max")
    )


def metric_sink(samples: DataFrame, root: str, emit: Callable[[DataFrame, int], None]) -> None:
    """Give every batch of metric events to a user hook, as a DataFrame."""
    query = (
        samples.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        .foreachBatch(emit).start()
    )
    query.awaitTermination()


_INGEST_METRICS = "chunks long, tokens long, characters long, duration_ms long"


def stream_ingest(documents: DataFrame, root: str, target: int = V.CHUNK_TARGET_TOKENS,
                  overlap: int = V.CHUNK_OVERLAP_TOKENS) -> None:
    """Chunk arriving documents (doc_id, version_id, text). A batch writes only its own folders, so nothing that
    is stored is rewritten: its chunks, and a row per version it brings, from which follows what is live. Versions
    of one document that arrive together are chunked apart. What a batch wrote is counted while it is written and kept as a row
    of metrics."""
    spark = documents.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        arrived = batch.select(F.struct("doc_id", "version_id").alias("doc_id"), "text")
        chunks = ingest.ingest_documents(arrived, target, overlap)
        counted, seen = metrics.observed(
            chunks.withColumns({"doc_id": F.col("doc_id.doc_id"), "version_id": F.col("doc_id.version_id")}), f"ingest-{batch_id}",
            chunks=F.count(F.lit(1)), tokens=F.coalesce(F.sum("token_count"), F.lit(0)), characters=F.coalesce(F.sum(F.length("content")), F.lit(0)))
        counted.write.mode("overwrite").parquet(f"{root}/chunks/batch_id={batch_id}")
        values = {**seen.get, "duration_ms": int((time.monotonic() - began) * 1000)}
        spark.createDataFrame([values], _INGEST_METRICS).write.mode("overwrite").parquet(f"{root}/metrics/batch_id={batch_id}")
        batch.select("version_id").distinct().write.mode("overwrite").parquet(f"{root}/versions/batch_id={batch_id}")

    query = (
        documents.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    query.awaitTermination()


def ingest_metrics(spark: SparkSession, root: str) -> DataFrame:
    """A row per batch: chunks, tokens, characters and duration_ms of its ingestion."""
    return spark.read.schema(_with(spark.createDataFrame([], _INGEST_METRICS).schema, "batch_id")).parquet(f"{root}/metrics")


def stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Stored chunks that are live: of each version those of the newest batch that brought it, also when it brought no text.
    The newest batch comes from the table of versions, which is small beside the chunks; chunks are only joined to it."""
    newest = spark.read.parquet(f"{root}/versions").groupBy("version_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{root}/chunks").join(newest, ["version_id", "batch_id"], "left_semi")
