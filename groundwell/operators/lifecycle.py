"""Job state, retries, versioned chunks and status roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.sources.tables import settle


def error_taxonomy(code: Column) -> tuple[Column, Column]:
    """(retryable, stage) of an error code; null for an unknown code."""
    retryable = F.create_map(*[F.lit(x) for c, (r, _) in V.ERROR_TAXONOMY.items() for x in (c, r)])
    stage = F.create_map(*[F.lit(x) for c, (_, s) in V.ERROR_TAXONOMY.items() for x in (c, s)])
    return F.try_element_at(retryable, code), F.try_element_at(stage, code)


def failure_status(retryable: Column, attempts: Column, max_attempts: Column) -> Column:
    return (
        F.when(retryable & (attempts >= max_attempts), "DEAD_LETTER").when(retryable, "WAITING").otherwise("FAILED")
    )


def job_states(events: DataFrame, max_attempts: int = V.JOB_MAX_ATTEMPTS) -> DataFrame:
    """Current state per job from its event log: status, attempts, and the event that decided it.

    An attempt starts at a `start` event and its outcome is the next event; everything after the first
    terminal outcome is ignored. A start while terminal, or an outcome without a running attempt, changes
    nothing. Window functions give this without holding a job's log in memory.
    """
    log = Window.partitionBy("job_id").orderBy("ts", "event_id")
    so_far = log.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_start = F.col("event") == "start"
    previous = F.lag("event").over(log)
    # an outcome counts when the attempt it closes is running: the last start has no outcome in between
    staged = events.withColumn("starts", F.count_if(is_start).over(so_far)).withColumn(
        "closes", ~is_start & F.coalesce(previous == "start", F.lit(False))
    )
    terminal = (
        F.when(~F.col("closes"), None)
        .when(F.col("event") == "success", "COMPLETED")
        .when(F.col("event") == "terminal_failure", "FAILED")
        .when((F.col("event") == "retryable_failure") & (F.col("starts") >= max_attempts), "DEAD_LETTER")
    )
    staged = staged.withColumn("terminal", terminal)
    first_terminal = F.count_if(F.col("terminal").isNotNull()).over(
        log.rowsBetween(Window.unboundedPreceding, -1)
    )
    alive = staged.withColumn("ended_before", first_terminal).filter("ended_before = 0")
    status = (
        F.when(F.col("terminal").isNotNull(), F.col("terminal"))
        .when(is_start, "ACTIVE").when(F.col("closes"), "WAITING")
    )
    moved = alive.withColumn("status", status)
    return moved.groupBy("job_id").agg(
        F.coalesce(
            F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("ts", "event_id"))), F.lit("WAITING")
        ).alias("status"),
        F.count_if(is_start).alias("attempts"),
        F.max(F.when(F.col("status").isNotNull(), F.col("ts"))).alias("changed_at"),
    )


def supersede_chunks(table: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Close the live rows of every version the batch brings, and add the batch as live rows.
    The result is the table's next state; versions outside the batch pass through unchanged."""
    touched = batch.select("version_id").distinct().withColumn("touched", F.lit(True))
    closing = F.col("touched") & F.col("superseded_at").isNull()
    closed = table.join(touched, "version_id", "left").withColumn(
        "superseded_at", F.when(closing, at).otherwise(F.col("superseded_at"))
    )
    fresh = batch.withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return closed.drop("touched").unionByName(fresh)


@dataclass(frozen=True)
class ChunkStore:
    """A chunk table in partitions of (knowledge base, bucket of the version), each in the folder of the generation that wrote it.

    A batch writes the partitions its versions lie in to a folder of its own, and then a manifest that says which generation of each
    partition counts. The manifest appears as a whole, when its folder is marked complete, and that is the switch: until then readers
    see the state before, and a failed batch is written again over its own folder. Nothing older is touched."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def _manifests(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/n=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        # the folder's name keeps the id a string, also where it reads like a number
        return rows.withColumn("kb", F.concat(F.lit("kb-"), "kb_id")).withColumn("bucket", F.pmod(F.xxhash64("version_id"), F.lit(self.buckets)).cast("int"))

    def _commit(self, rows: DataFrame, generation: int, before: DataFrame | None) -> None:
        """Write the partitions of rows as a generation, and the manifest in which they replace those of before(kb, bucket, generation)."""
        folder = f"{self.root}/data/generation={generation}"
        rows.repartition("kb", "bucket").write.mode("overwrite").partitionBy("kb", "bucket").parquet(folder)
        own = self.spark.read.parquet(folder).select("kb", "bucket").distinct().withColumn("generation", F.lit(generation))
        if before is not None:
            own = before.join(own, ["kb", "bucket"], "left_anti").select("kb", "bucket", "generation").unionByName(own)
        own.write.mode("overwrite").parquet(f"{self.root}/manifest/n={generation}")

    def create(self, rows: DataFrame) -> None:
        self._commit(self._partitioned(rows), 0, None)

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/manifest/n={self._manifests()[-1]}")

    def read(self) -> DataFrame:
        """Rows of the generation that counts for their partition; other folders are pruned."""
        return self._current(self.manifest()).drop("kb", "bucket", "generation")

    def _current(self, partitions: DataFrame) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data").join(partitions, ["generation", "kb", "bucket"], "left_semi")

    def supersede(self, batch: DataFrame, at: Column) -> None:
        """Close the live rows of every version the batch brings and add the batch, in the partitions that hold these versions."""
        manifest = self.manifest()
        fresh = settle(self._partitioned(batch), "supersede-batch")
        touched = manifest.join(fresh.select("kb", "bucket").distinct(), ["kb", "bucket"], "left_semi")
        old = self._current(touched).drop("generation")
        state = supersede_chunks(old, fresh.select(*[c for c in old.columns if c != "superseded_at"]), at)
        self._commit(state, self._manifests()[-1] + 1, manifest)


def live_chunks(table: DataFrame) -> DataFrame:
    return table.filter(F.col("superseded_at").isNull())


_VERSION_STATUS = {"WAITING": "QUEUED", "ACTIVE": "PROCESSING", "COMPLETED": "INDEXED", "FAILED": "FAILED",
                   "DEAD_LETTER": "FAILED"}
_VECTOR_STATUS = {"WAITING": "PENDING", "ACTIVE": "PENDING", "COMPLETED": "COMPLETED", "FAILED": "FAILED",
                  "DEAD_LETTER": "FAILED"}


def status_rollup(jobs: DataFrame, versions: DataFrame, embeddings_enabled: bool = True) -> DataFrame:
    """Newest job per version decides the version status; the newest version decides the document status."""
    newest_job = Window.partitionBy("version_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    current = jobs.withColumn("n", F.row_number().over(newest_job)).filter("n = 1").select(
        "version_id", F.col("status").alias("job_status"), F.col("attempts").alias("job_attempts")
    )

    def lookup(table: dict[str, str]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("job_status"))

    retrying = (F.col("job_status") == "WAITING") & (F.col("job_attempts") > 0)
    version_status = F.when(retrying, "PROCESSING").otherwise(lookup(_VERSION_STATUS))
    vector_status = lookup(_VECTOR_STATUS) if embeddings_enabled else F.lit("DISABLED")
    newest_version = Window.partitionBy("doc_id").orderBy(F.desc("version_number"))
    return (
        versions.select("version_id", "doc_id", "version_number", "chunk_count").join(current, "version_id")
        .withColumn("version_status", version_status).withColumn("vectorization_status", vector_status)
        .withColumn("chunk_count", F.when(F.col("version_status") == "INDEXED", F.col("chunk_count")).otherwise(0))
        .withColumn("is_newest", F.row_number().over(newest_version) == 1)
        .withColumn("document_status", F.when(F.col("is_newest"), F.col("version_status")))
        .drop("job_attempts")
    )


def requeue(jobs: DataFrame, versions: DataFrame, eligible: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(versions with a bumped ingest version, jobs with a new waiting job) for eligible (version_id) rows."""
    chosen = eligible.select("version_id").distinct().withColumn("chosen", F.lit(True))
    bumped = versions.join(chosen, "version_id", "left").withColumn(
        "ingest_version", F.col("ingest_version") + F.when(F.col("chosen"), 1).otherwise(0)
    ).withColumn("status", F.when(F.col("chosen"), "QUEUED").otherwise(F.col("status"))) \
        .withColumn("started_at", F.when(F.col("chosen").isNull(), F.col("started_at"))) \
        .withColumn("finished_at", F.when(F.col("chosen").isNull(), F.col("finished_at"))).drop("chosen")
    last = jobs.join(chosen, "version_id", "left_semi").groupBy("version_id", "doc_id", "kb_id").agg(
        (F.max("job_id") + 1).alias("job_id"), F.max("max_attempts").alias("max_attempts")
    )
    new_jobs = last.select(
        "job_id", "version_id", "doc_id", "kb_id", F.lit("WAITING").alias("status"),
        F.lit(0).cast("long").alias("attempts"), "max_attempts", at.alias("created_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    return bumped, jobs.unionByName(new_jobs)


def archive_kbs(kbs: DataFrame, archived: DataFrame, at: Column) -> DataFrame:
    """Mark the knowledge bases of `archived` (kb_id); their rows stay, only visibility changes."""
    mark = archived.select("kb_id").distinct().withColumn("mark", F.lit(True))
    return kbs.join(mark, "kb_id", "left").withColumn(
        "status", F.when(F.col("mark"), "ARCHIVED").otherwise(F.col("status"))
    ).withColumn("archived_at", F.when(F.col("mark"), at)).drop("mark")
