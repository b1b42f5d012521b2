"""Tables in and out: schemas, job messages, vector text, partitioned chunk tables, upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: message and table schemas ---------------------------------
JOB_MESSAGE = (
    "ingestJobId string, documentId string, documentVersionId string, kbId string, bucket string, s3Key string, "
    "mimeType string, sourceTitle string, correlationId string, pipelineVersion string, ingestVersion int"
)
TABLE_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def scan_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table under its declared schema; nothing is inferred."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def parse_job_message(message: Column) -> Column:
    return F.from_json(message, JOB_MESSAGE)


def build_job_message(**fields: Column) -> Column:
    """JSON message from the eleven fields, in the order of the schema."""
    names = [part.strip().split(" ")[0] for part in JOB_MESSAGE.split(",")]
    return F.to_json(F.struct(*[fields[n].alias(n) for n in names if n in fields]))


def vector_to_text(vector: Column) -> Column:
    """`[a,b,...]` with twelve decimals; an exact tie goes to the even digit."""
    def number(x: Column) -> Column:
        exact = x.cast("double").cast("decimal(38,20)")
        return F.format_string("%.12f", F.bround(exact, 12).cast("double"))

    shown = F.transform(vector, number)
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))


def text_to_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the session's checkpoint directory. Only a local session may do without that setting:
    on a cluster a folder of one machine would be missing on the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="groundwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of an execution when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and go on from the written table:
    it is computed once, and a lost executor costs a file read instead of the whole lineage.

    What was shuffled for it is deleted once it is written. Else it stays on the executors' disks until the driver collects its
    garbage, and a job of many such steps holds the shuffles of all of them."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write a chunk table partitioned by knowledge base; only the partitions present are replaced.

    A salt next to the partition key spreads a large knowledge base over several files and tasks.
    """
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(16))
    (
        chunks.repartition("kb_id", spread).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
    )


def upsert_by_key(current: DataFrame, incoming: DataFrame, keys: list[str], newest: Column | None = None) -> DataFrame:
    """Insert or update: a full outer join where a new non-null value wins. Applying it twice changes nothing.
    Of several incoming rows of a key the one that is greatest in `newest` counts; without it, the one that arrived last."""
    values = [c for c in current.columns if c not in keys]
    order = newest if newest is not None else F.monotonically_increasing_id()
    new = F.struct(*[F.col(c).alias(f"new_{c}") for c in values])
    latest = incoming.withColumn("__new", new).withColumn("__order", order).groupBy(*keys).agg(F.max_by("__new", "__order").alias("__new")).select(*keys, "__new.*")
    return current.join(latest, keys, "full_outer").select(
        *keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in values]
    )


def skip_if_indexed(incoming: DataFrame, documents: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Incoming files (doc_id, content_hash) that are neither indexed with this content nor queued with it."""
    indexed = (
        versions.filter("status = 'INDEXED'").join(documents.filter("status = 'INDEXED'").select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "content_hash")
    )
    queued = versions.join(
        jobs.filter("status IN ('WAITING', 'ACTIVE')").select("version_id"), "version_id", "left_semi"
    ).select("doc_id", "content_hash")
    return incoming.join(indexed.union(queued).distinct(), ["doc_id", "content_hash"], "left_anti")
