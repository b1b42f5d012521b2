"""Merge of the two candidate lists, the five-signal score, and the reranked top N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import scoring as S
from groundwell.functions import text as T
from groundwell.operators import scope


def merge_candidates(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer merge by (query_id, chunk_id): ranks, raw scores, and where each candidate came from."""
    left = semantic.groupBy("query_id", "chunk_id").agg(
        F.min("semantic_distance").alias("semantic_distance"),
        F.max("semantic_similarity").alias("semantic_similarity"),
        F.min("semantic_rank").alias("semantic_rank"),
    )
    right = lexical.groupBy("query_id", "chunk_id").agg(
        F.max("lexical_raw").alias("lexical_raw"), F.min("lexical_rank").alias("lexical_rank")
    )
    return left.join(right, ["query_id", "chunk_id"], "full_outer").withColumn("retrieved_by", provenance())


def provenance() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("semantic_rank").isNotNull(), F.lit("semantic")),
        F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")),
    ))


def with_candidate_terms(candidates: DataFrame) -> DataFrame:
    """Term arrays of the texts a score looks at, computed once per candidate."""
    title = F.coalesce(F.nullif("source_title", F.lit("")), F.col("document_title"))
    return candidates.select(
        "*",
        T.terms(F.col("search_text")).alias("search_terms"),
        T.search_text(F.coalesce("section_title", F.lit(""))).alias("section_match"),
        T.search_text(title).alias("title_match"),
        T.metadata_terms(F.col("metadata_json")).alias("meta_terms"),
    )


def lexical_score() -> Column:
    return S.clamp01(
        0.55 * S.lexical_rank_norm(F.col("lexical_raw"))
        + 0.25 * F.col("token_coverage") + 0.2 * F.col("phrase_coverage")
    )


def _best_coverage(text: Column) -> Column:
    return F.greatest(
        S.token_coverage(T.terms(text), F.col("tokens")), S.phrase_coverage(text, F.col("phrases"))
    )


def metadata_signals_and_score(df: DataFrame) -> DataFrame:
    """Mean of the signals that apply: document filter, language filter, tag coverage."""
    has_ids, has_languages = F.size("document_ids") > 0, F.size("languages") > 0
    matched = scope.filter_signals()
    asked = (F.size("tokens") > 0) | (F.size("phrases") > 0)
    tagged = (F.size("meta_terms") > 0) & asked
    tags = F.greatest(
        S.token_coverage(F.col("meta_terms"), F.col("tokens")),
        S.phrase_coverage(F.array_join("meta_terms", " "), F.col("phrases")),
    )
    by_id, by_language = F.array_contains(matched, "document_filter"), F.array_contains(matched, "language_filter")
    parts = F.array_compact(F.array(
        F.when(has_ids, by_id.cast("double")), F.when(has_languages, by_language.cast("double")),
        F.when(tagged, tags),
    ))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    signals = F.array_compact(F.array(
        F.when(has_ids & by_id, F.lit("document filter matched")),
        F.when(has_languages & by_language, F.lit("language filter matched")),
        F.when(tagged & (tags > 0), F.lit("metadata tags aligned")),
    ))
    return df.select(
        "*", S.round_fixed(S.share(total, F.size(parts)), 6).alias("metadata_score"),
        signals.alias("metadata_signals"),
    )


def structural_signals_and_score(df: DataFrame) -> DataFrame:
    """Section title, source title and question-and-answer layout."""
    staged = df.select(
        "*",
        _best_coverage(F.col("section_match")).alias("section_coverage"),
        _best_coverage(F.col("title_match")).alias("title_coverage"),
        (F.col("question_like") & S.faq_like(
            F.col("section_title"), F.col("source_title"), T.search_text(F.col("content"))
        )).alias("faq_match"),
    )
    score = S.clamp01(
        0.55 * F.col("section_coverage") + 0.3 * F.col("title_coverage") + 0.15 * F.col("faq_match").cast("double")
    )
    signals = F.array_compact(F.array(
        F.when(F.col("section_coverage") > 0, F.lit("section title aligned")),
        F.when(F.col("title_coverage") > 0, F.lit("source title aligned")),
        F.when(F.col("faq_match"), F.lit("faq style chunk")),
    ))
    return staged.select(
        "*", S.round_fixed(score, 6).alias("structural_score"), signals.alias("structural_signals")
    ).drop("section_coverage", "title_coverage", "faq_match")


def hybrid_score(weights: dict[str, float] = V.HYBRID_WEIGHTS) -> Column:
    return S.round_fixed(
        weights["semantic"] * F.col("semantic_score")
        + weights["lexical"] * F.col("lexical_score")
        + weights["metadata"] * F.col("metadata_score")
        + weights["recency"] * F.col("recency_score")
        + weights["structural"] * F.col("structural_score"), 6,
    )


def selection_reason() -> Column:
    """Up to three phrases saying why a candidate ranks where it does."""
    semantic = F.col("semantic_score")
    reasons = F.array_compact(F.array(
        F.when(F.size("retrieved_by") == 2, F.lit("semantic and lexical retrieval agreed")),
        F.when(semantic >= 0.75, F.lit("strong semantic match"))
        .when(semantic >= 0.55, F.lit("good semantic match")),
        F.when(F.col("phrase_coverage") > 0, F.lit("exact phrase match"))
        .when(F.col("token_coverage") >= 0.6, F.lit("high lexical overlap")),
        F.when(F.col("metadata_score") > 0, F.get("metadata_signals", F.lit(0))),
        F.when(F.col("structural_score") >= 0.2, F.get("structural_signals", F.lit(0))),
        F.when(
            F.col("freshness_intent") & (F.col("recency_score") >= 0.45),
            F.lit("fresh content for time-sensitive query"),
        ),
    ))
    text = F.array_join(F.slice(reasons, 1, 3), "; ")
    return F.when(F.size(reasons) > 0, text).otherwise(F.lit("scored from available signals"))


_QUESTION_COLUMNS = [
    "query_id", "tokens", "phrases", "freshness_intent", "question_like", "document_ids", "languages"
]


def score_candidates(
    merged: DataFrame, prepared: DataFrame, chunks: DataFrame, as_of: Column,
    weights: dict[str, float] = V.HYBRID_WEIGHTS,
) -> DataFrame:
    """Five scores and the hybrid score for merged candidates. `prepared` is a preprocessed question table."""
    candidates = merged.join(prepared.select(*_QUESTION_COLUMNS), "query_id").join(chunks, "chunk_id")
    staged = with_candidate_terms(candidates).select(
        "*",
        S.semantic_score(F.col("semantic_distance")).alias("semantic_score"),
        S.token_coverage(F.col("search_terms"), F.col("tokens")).alias("token_coverage"),
        S.phrase_coverage(F.col("search_text"), F.col("phrases")).alias("phrase_coverage"),
        S.recency_score(F.col("indexed_at"), F.col("freshness_intent"), as_of).alias("recency_score"),
    ).withColumn("lexical_score", lexical_score())
    staged = structural_signals_and_score(metadata_signals_and_score(staged))
    return staged.withColumn("hybrid_score", hybrid_score(weights)).withColumn(
        "selection_reason", selection_reason()
    )


def rerank(scored: DataFrame, limit: int = V.RERANK_LIMIT) -> DataFrame:
    """The best `limit` candidates per question under a total order, with `rank_before_dedup`."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("hybrid_score"), F.desc("semantic_score"), F.desc("lexical_score"), F.desc("metadata_score"),
        F.desc("structural_score"), F.desc_nulls_last("indexed_at"), F.asc("chunk_id"),
    )
    return scored.withColumn("rank_before_dedup", F.row_number().over(order)).filter(
        F.col("rank_before_dedup") <= max(1, limit)
    )
