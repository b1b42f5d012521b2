"""Suppression of duplicate candidates. A question brings at most the rerank limit of rows (24), so its
rows fit one array and the greedy pass is a fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import scoring as S
from groundwell.functions import text as T

_FOLDED = [
    "rank_before_dedup", "chunk_id", "checksum", "version_id", "chunk_no", "search_terms", "phrase_coverage",
    "structural_score", "structural_hits",
]


def exact_duplicates(rows: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """Flag rows whose checksum already appeared earlier in the partition.

    The first row is found in two steps: among the rows of a checksum that one input task read, then among those firsts. A line
    that a third of all rows repeat is spread like the input, and only one row an input task meets the others."""
    dealt = rows.withColumn("__task", F.spark_partition_id())
    near = Window.partitionBy(*partition, "checksum", "__task").orderBy(*order)
    first = dealt.withColumn("__first", F.row_number().over(near) == 1)
    # rows that are not first stay with their task's rows; the firsts of a checksum meet under the number -1
    far = Window.partitionBy(*partition, "checksum", "__meet").orderBy(*order)
    met = first.withColumn("__meet", F.when(F.col("__first"), -1).otherwise(F.col("__task")))
    return met.withColumn("is_duplicate", ~F.col("__first") | (F.row_number().over(far) > 1)).drop("__task", "__first", "__meet")


def is_near_duplicate(kept: Column, other: Column, threshold: float = V.NEAR_DUP_JACCARD) -> Column:
    """Neighbouring chunks of one version with almost the same terms, unless `other` brings more phrase
    coverage or clearly more structure."""
    adjacent = (kept["version_id"] == other["version_id"]) & (
        F.abs(kept["chunk_no"] - other["chunk_no"]) <= 1
    )
    adds_phrase = F.round(other["phrase_coverage"], 6) > F.round(kept["phrase_coverage"], 6)
    adds_structure = (other["structural_score"] > kept["structural_score"] + 0.1) & (other["structural_hits"] > 0)
    alike = S.jaccard(kept["search_terms"], other["search_terms"]) >= threshold
    return adjacent & ~adds_phrase & ~adds_structure & alike


def duplicate_reason(kept: Column, other: Column) -> Column:
    same = (kept["chunk_id"] == other["chunk_id"]) | (kept["checksum"] == other["checksum"])
    return F.when(same, F.concat(F.lit("duplicate of "), kept["chunk_id"])).when(
        is_near_duplicate(kept, other), F.concat(F.lit("near-duplicate of "), kept["chunk_id"])
    )


def suppress_duplicates(ranked: DataFrame) -> DataFrame:
    """Greedy in rank order: add `dedup_reason` (null when kept) and `rank_after_dedup`. A question's rows meet once, in one array."""
    rows = ranked.withColumn("structural_hits", F.size("structural_signals"))
    item_type = "struct<" + ",".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in rows.select(*_FOLDED).schema
    ) + ">"

    def step(state: Column, row: Column) -> Column:
        candidate = F.struct(*[row[c].alias(c) for c in _FOLDED])
        hit = F.get(F.filter(state["kept"], lambda k: duplicate_reason(k, candidate).isNotNull()), F.lit(0))
        reason = duplicate_reason(hit, candidate)
        return F.struct(
            F.when(hit.isNull(), F.concat(state["kept"], F.array(candidate))).otherwise(state["kept"]).alias("kept"),
            F.concat(state["reasons"], F.array(F.coalesce(reason, F.lit("")))).alias("reasons"),
        )

    start = F.struct(
        F.array().cast(f"array<{item_type}>").alias("kept"), F.array().cast("array<string>").alias("reasons")
    )
    others = [c for c in ranked.columns if c not in ("query_id", "rank_before_dedup")]
    items = F.array_sort(F.collect_list(F.struct("rank_before_dedup", *others, "structural_hits")))
    folded = rows.groupBy("query_id").agg(items.alias("items")).select(
        "query_id", "items", F.aggregate("items", start, step, lambda s: s["reasons"]).alias("reasons")
    )

    def judged(x: Column, i: Column) -> Column:
        reason = F.get("reasons", i)
        kept = F.size(F.filter(F.slice("reasons", F.lit(1), i + 1), lambda r: r == ""))
        return F.struct(
            *[x[c].alias(c) for c in ["rank_before_dedup", *others]], F.when(reason == "", kept).alias("rank_after_dedup"),
            F.nullif(reason, F.lit("")).alias("dedup_reason"),
        )

    return folded.select("query_id", F.inline(F.transform("items", judged)))


def near_duplicate_pairs(chunks: DataFrame, threshold: float = V.NEAR_DUP_JACCARD) -> DataFrame:
    """Neighbouring chunks of one version with almost the same terms. Terms are made once and before the shuffle; a chunk meets the
    one that follows it, and only if that has the next number."""
    own = chunks.select("version_id", "chunk_no", F.col("chunk_id").alias("left_id"), T.terms(F.col("search_text")).alias("left_terms"))
    following = Window.partitionBy("version_id").orderBy("chunk_no", "left_id")
    paired = own.withColumn("after", F.lead(F.struct("chunk_no", F.col("left_id").alias("right_id"), F.col("left_terms").alias("right_terms"))).over(following))
    overlap = S.jaccard(F.col("left_terms"), F.col("after.right_terms"))
    return (
        paired.filter(F.col("after.chunk_no") == F.col("chunk_no") + 1).withColumn("jaccard", overlap)
        .filter(F.col("jaccard") >= threshold).select("version_id", "left_id", "after.right_id", "jaccard")
    )
