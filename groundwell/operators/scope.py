"""Access scope: who may read what, role decisions, and the filters of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V


def users_with_role(user_roles: DataFrame, allowed: list[str]) -> DataFrame:
    """(user_id, allowed): whether the user holds any of the roles. An empty list allows everybody."""
    hit = F.lit(True) if not allowed else F.col("system_role").isin(allowed)
    return user_roles.groupBy("user_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("allowed"))


def admins(user_roles: DataFrame) -> DataFrame:
    return user_roles.filter("system_role = 'SUPER_ADMIN'").select("user_id").distinct()


def operators(user_roles: DataFrame) -> DataFrame:
    return user_roles.filter("system_role IN ('SUPER_ADMIN', 'OPERATOR')").select("user_id").distinct()


def readable_kbs(requests: DataFrame, kbs: DataFrame, members: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Requests (user_id, kb_id, ...) whose knowledge base is active and whose user is admin or member."""
    active = kbs.filter("status = 'ACTIVE'").select("kb_id")
    scoped = requests.join(active, "kb_id", "left_semi")
    is_admin = admins(user_roles).withColumn("is_admin", F.lit(True))
    member = members.select("kb_id", "user_id").distinct().withColumn("is_member", F.lit(True))
    return (
        scoped.join(is_admin, "user_id", "left").join(member, ["kb_id", "user_id"], "left")
        .filter("is_admin OR is_member").drop("is_admin", "is_member")
    )


def readable_documents(
    requests: DataFrame, documents: DataFrame, kbs: DataFrame, members: DataFrame, user_roles: DataFrame
) -> DataFrame:
    """Requests (user_id, doc_id) whose document lies in a readable knowledge base."""
    placed = requests.join(documents.select("doc_id", "kb_id"), "doc_id")
    return readable_kbs(placed, kbs, members, user_roles)


def readable_conversations(
    requests: DataFrame, conversations: DataFrame, kbs: DataFrame, members: DataFrame, user_roles: DataFrame
) -> DataFrame:
    """Admins read all conversations of active knowledge bases; others only their own, while still members."""
    owned = conversations.select("conversation_id", "kb_id", F.col("user_id").alias("owner_id"))
    placed = requests.join(owned, "conversation_id")
    readable = readable_kbs(placed, kbs, members, user_roles)
    is_admin = admins(user_roles).withColumn("is_admin", F.lit(True))
    return (
        readable.join(is_admin, "user_id", "left")
        .filter(F.coalesce("is_admin", F.lit(False)) | (F.col("owner_id") == F.col("user_id")))
        .drop("is_admin", "owner_id")
    )


def role_priority(role: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in V.KB_ROLE_PRIORITY.items() for x in pair])
    return F.try_element_at(ranks, role)


def role_decisions(
    requests: DataFrame, kbs: DataFrame, members: DataFrame, user_roles: DataFrame
) -> DataFrame:
    """Decide requests (user_id, kb_id, allowed_roles): allowed, forbidden, or not_found."""
    is_admin = admins(user_roles).withColumn("is_admin", F.lit(True))
    active = kbs.filter("status = 'ACTIVE'").select("kb_id").withColumn("is_active", F.lit(True))
    decided = (
        F.when(F.col("is_active").isNull(), "not_found")
        .when(F.col("is_admin"), "allowed")
        .when(F.col("role").isNull(), "not_found")
        .when(F.array_contains("allowed_roles", F.col("role")), "allowed")
        .otherwise("forbidden")
    )
    return (
        requests.join(active, "kb_id", "left").join(is_admin, "user_id", "left")
        .join(members, ["kb_id", "user_id"], "left")
        .withColumn("decision", decided).drop("is_active", "is_admin", "role")
    )


def last_owner_guard(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Judge membership changes (kb_id, user_id, next_role or null to remove): `blocked` when the
    knowledge base would lose its last owner."""
    owners = members.groupBy("kb_id").agg(F.count_if(F.col("role") == "OWNER").alias("owners"))
    current = members.select("kb_id", "user_id", F.col("role").alias("current_role"))
    blocked = (
        (F.col("current_role") == "OWNER")
        & (F.coalesce("next_role", F.lit("")) != "OWNER")
        & (F.col("owners") <= 1)
    )
    return (
        requests.join(current, ["kb_id", "user_id"], "left").join(owners, "kb_id", "left")
        .withColumn("blocked", F.coalesce(blocked, F.lit(False)))
    )


def live_chunks_in_scope(chunks: DataFrame, versions: DataFrame, documents: DataFrame, kbs: DataFrame) -> DataFrame:
    """Chunks joined to their version, document and knowledge base, kept while all of them are live."""
    live = chunks.filter("superseded_at IS NULL") if "superseded_at" in chunks.columns else chunks
    return (
        live.join(versions.filter("status = 'INDEXED'").select("version_id"), "version_id", "left_semi")
        .join(documents.filter("status = 'INDEXED'").select("doc_id"), "doc_id", "left_semi")
        .join(kbs.filter("status = 'ACTIVE'").select("kb_id"), "kb_id", "left_semi")
    )


def embedding_compatible(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    return chunks.filter(
        F.col("embedding").isNotNull() & (F.col("embedding_model") == model) & (F.col("embedding_dim") == dim)
    )


def filter_match() -> Column:
    """Whether a chunk passes the question's optional document and language filters."""
    ids, languages = F.col("document_ids"), F.col("languages")
    by_id = (F.size(ids) == 0) | F.array_contains(ids, F.col("doc_id"))
    language = F.lower(F.coalesce("language", F.lit("")))
    return by_id & ((F.size(languages) == 0) | F.array_contains(languages, language))


def filter_signals() -> Column:
    """Names of the filters that are set and matched."""
    ids, languages = F.col("document_ids"), F.col("languages")
    by_id = (F.size(ids) > 0) & F.array_contains(ids, F.col("doc_id"))
    by_language = (F.size(languages) > 0) & F.array_contains(languages, F.lower("language"))
    return F.array_compact(
        F.array(F.when(by_id, F.lit("document_filter")), F.when(by_language, F.lit("language_filter")))
    )


def scope_violations(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieved chunks that lie outside the knowledge base of their question."""
    asked = questions.select("query_id", F.col("kb_id").alias("asked_kb_id"))
    return candidates.join(asked, "query_id").filter(F.col("kb_id") != F.col("asked_kb_id"))

