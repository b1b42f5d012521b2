"""Entity views: newest versions and jobs, conversations, listings, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import scope


def newest(rows: DataFrame, by: str, order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows per key; the limit reaches the map side as a window group limit."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("position") <= keep)


def _version_order() -> list[Column]:
    return [F.desc("version_number"), F.desc("created_at")]


def latest_version_job(documents: DataFrame, versions: DataFrame, jobs: DataFrame, job_limit: int = 1) -> DataFrame:
    """Per document its newest version and, as a list newest first, that version's newest jobs."""
    version = newest(versions, "doc_id", _version_order()).select(
        "doc_id", "version_id", "version_number", F.col("status").alias("version_status"), "chunk_count"
    )
    recent = newest(jobs, "version_id", [F.desc("created_at"), F.desc("job_id")], job_limit)
    listed = recent.groupBy("version_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "job_id", "status", "attempts"))).alias("jobs")
    )
    return (
        documents.select("doc_id", "kb_id", "status").join(version, "doc_id", "left")
        .join(listed, "version_id", "left")
    )


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Newest message per conversation; the order of the list is `last_activity_at` descending."""
    latest = messages.groupBy("conversation_id").agg(
        F.max_by(
            F.struct("message_id", "role", "content"), F.struct("created_at", "message_id")
        ).alias("last_message"),
        F.max("created_at").alias("last_activity_at"),
    )
    return conversations.join(latest, "conversation_id").orderBy(F.desc("last_activity_at"))


def message_page(messages: DataFrame, citations: DataFrame, limit: int = V.MESSAGE_PAGE_LIMIT) -> DataFrame:
    """The last `limit` (1 to 100) messages per conversation, numbered oldest first, with their citations."""
    page = newest(messages, "conversation_id", [F.desc("created_at"), F.desc("message_id")], max(1, min(limit, 100)))
    number = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    cited = citations.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("citations")
    )
    return page.withColumn("page_position", F.row_number().over(number)).drop("position").join(
        cited, "message_id", "left"
    )


def prompt_history(messages: DataFrame, limit: int = V.PROMPT_HISTORY_LIMIT) -> DataFrame:
    """The last `limit` messages oldest first; SYSTEM messages are dropped only after the limit."""
    recent = newest(messages, "conversation_id", [F.desc("created_at"), F.desc("message_id")], max(0, limit))
    number = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    return (
        recent.filter("role <> 'SYSTEM'").withColumn("history_position", F.row_number().over(number))
        .drop("position")
    )


def conversation_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_activity_at"))


def unique_slugs(kbs: DataFrame, max_len: int | None = None) -> DataFrame:
    """Slug per knowledge base; repeats get -2, -3, ... by creation."""
    based = kbs.withColumn("base_slug", T.slugify(F.col("name"), max_len))
    order = Window.partitionBy("base_slug").orderBy("created_at", "kb_id")
    rank = F.row_number().over(order)
    return based.withColumn("slug_rank", rank).withColumn(
        "slug",
        F.when(F.col("slug_rank") == 1, F.col("base_slug"))
        .otherwise(F.concat_ws("-", "base_slug", F.col("slug_rank").cast("string"))),
    )


def job_eligibility(jobs: DataFrame) -> DataFrame:
    """Whether a job may be retried: `ok`, `not_failed`, `not_latest` or `active_sibling`."""
    version = Window.partitionBy("version_id")
    newest_first = version.orderBy(F.desc("created_at"), F.desc("job_id"))
    busy = F.bool_or(F.col("status").isin("WAITING", "ACTIVE")).over(version)
    verdict = (
        F.when(~F.col("status").isin("FAILED", "DEAD_LETTER"), "not_failed")
        .when(F.col("job_order") > 1, "not_latest")
        .when(F.col("busy"), "active_sibling").otherwise("ok")
    )
    return (
        jobs.withColumn("job_order", F.row_number().over(newest_first)).withColumn("busy", busy)
        .withColumn("retry", verdict).drop("job_order", "busy")
    )


def failed_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Failed and dead-letter jobs, latest finish first; the limit is kept within 1 and 200."""
    return (
        jobs.filter("status IN ('FAILED', 'DEAD_LETTER')")
        .orderBy(F.desc("finished_at"), F.desc("created_at"), F.desc("job_id"))
        .limit(max(1, min(limit, 200)))
    )


def reindex_eligibility(documents: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether a document may be indexed again: `ok`, `no_version` or `busy`."""
    version = newest(versions, "doc_id", _version_order()).select("doc_id", "version_id")
    busy = jobs.filter("status IN ('WAITING', 'ACTIVE')").select("version_id").distinct().withColumn("busy", F.lit(True))
    verdict = F.when(F.col("version_id").isNull(), "no_version").when(F.col("busy"), "busy").otherwise("ok")
    return (
        documents.select("doc_id").join(version, "doc_id", "left").join(busy, "version_id", "left")
        .select("doc_id", "version_id", verdict.alias("reindex"))
    )


def kb_listing(kbs: DataFrame, members: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """Active knowledge bases one caller may read, newest update first, with the caller's role."""
    listed = membership(kbs.filter("status = 'ACTIVE'"), members, user_id)
    if is_admin:
        listed = listed.withColumn("caller_role", F.lit("ADMIN"))
    return listed.filter("caller_role IS NOT NULL").orderBy(F.desc("updated_at"), F.asc("kb_id"))


def kb_counts(kbs: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases with member and document counts, each counted before the join."""
    member_counts = members.groupBy("kb_id").agg(F.count("*").alias("member_count"))
    document_counts = documents.groupBy("kb_id").agg(F.count("*").alias("document_count"))
    return (
        kbs.join(member_counts, "kb_id", "left").join(document_counts, "kb_id", "left")
        .na.fill({"member_count": 0, "document_count": 0})
    )


def membership(chunks: DataFrame, members: DataFrame, user_id: Column | int) -> DataFrame:
    """Left join of the caller's membership; null role when there is none."""
    mine = members.filter(F.col("user_id") == user_id).select("kb_id", F.col("role").alias("caller_role"))
    return chunks.join(mine, "kb_id", "left")


def chunk_lineage(chunks: DataFrame, versions: DataFrame, documents: DataFrame, kbs: DataFrame) -> DataFrame:
    """Chunk with its version, document and knowledge base."""
    return (
        chunks.join(versions.select("version_id", "version_number", F.col("status").alias("version_status")), "version_id")
        .join(documents.select("doc_id", F.col("name").alias("document_name")), "doc_id")
        .join(kbs.select("kb_id", F.col("status").alias("kb_status")), "kb_id")
    )


def candidate_base(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Retrieval projection; the source title falls back to the document's name."""
    names = documents.select("doc_id", F.col("name").alias("document_name"))
    return chunks.join(names, "doc_id").withColumn("source_title", F.coalesce("source_title", "document_name"))


def job_lineage(jobs: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    return jobs.drop("doc_id", "kb_id").join(
        versions.select("version_id", "doc_id", "version_number"), "version_id"
    ).join(documents.select("doc_id", "kb_id", "name"), "doc_id")


def citation_scope_violations(citations: DataFrame, conversations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations whose chunk is not in the knowledge base of their conversation."""
    placed = citations.join(conversations.select("conversation_id", "kb_id"), "conversation_id")
    return placed.join(chunks.select("chunk_id", "kb_id"), ["chunk_id", "kb_id"], "left_anti")


def citation_backfill(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Add document id and title to citations that only know their chunk."""
    return citations.join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(
        documents.select("doc_id", F.col("name").alias("document_title")), "doc_id"
    )


def version_status_backfill(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Version status and vectorization status derived from the document's status."""
    state = documents.select("doc_id", F.col("status").alias("document_status"))
    known = F.col("document_status").isin("INDEXED", "FAILED", "PROCESSING")
    return versions.select("version_id", "doc_id").join(state, "doc_id").select(
        "version_id",
        F.when(known, F.col("document_status")).otherwise("QUEUED").alias("status"),
        F.when(F.col("document_status") == "INDEXED", "DISABLED").otherwise("PENDING").alias("vectorization_status"),
    )
