"""The read path for a table of questions: candidates, hybrid rank, duplicate suppression, grounding set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import dedup, hybrid, lexical, semantic
from groundwell.operators.index import ChunkIndex
from groundwell.sources.tables import settle


def candidates(
    prepared: DataFrame, question_vectors: DataFrame, index: ChunkIndex, candidate_limit: int = V.CANDIDATE_LIMIT,
) -> DataFrame:
    """Merged candidates of every question, ids and scores only: written, because their size decides how chunks are fetched."""
    by_words = lexical.lexical_topk(lexical.lexical_matches(lexical.query_clauses(prepared), index), candidate_limit)
    by_vector = semantic.semantic_topk(question_vectors, index, candidate_limit)
    return settle(hybrid.merge_candidates(by_vector, by_words), "candidates")


def candidate_chunks(merged: DataFrame, index: ChunkIndex) -> DataFrame:
    """The chunks that are a candidate of some question. Others drop out where they are read, before any text is shuffled."""
    return index.chunks.join(merged.select("chunk_id").distinct(), "chunk_id", "left_semi")


def retrieve(
    questions: DataFrame, question_vectors: DataFrame, index: ChunkIndex, as_of: Column,
    candidate_limit: int = V.CANDIDATE_LIMIT, rerank_limit: int = V.RERANK_LIMIT,
) -> DataFrame:
    """Ranked candidates of every question, duplicates marked."""
    prepared = settle(T.preprocess(questions), "prepared")
    merged = candidates(prepared, question_vectors, index, candidate_limit)
    scored = hybrid.score_candidates(merged, prepared, candidate_chunks(merged, index), as_of)
    return dedup.suppress_duplicates(hybrid.rerank(scored, rerank_limit))


def grounding(retrieved: DataFrame, limit: int = V.GROUNDING_LIMIT) -> DataFrame:
    """The first `limit` candidates left after suppression."""
    return retrieved.filter(F.col("rank_after_dedup") <= limit)


def retrieval_summary(questions: DataFrame, retrieved: DataFrame, limit: int = V.GROUNDING_LIMIT) -> DataFrame:
    """One row per question, also for those that found nothing or had no text at all."""
    selected = F.col("rank_after_dedup") <= limit
    per_question = retrieved.groupBy("query_id").agg(
        F.count("*").alias("total_candidates"),
        F.count_if(selected).alias("selected_chunks"),
        F.max(F.when(F.col("rank_after_dedup") == 1, F.col("hybrid_score"))).alias("top_score"),
        F.bool_or(F.array_contains("retrieved_by", "semantic")).alias("semantic_used"),
        F.bool_or(F.array_contains("retrieved_by", "lexical")).alias("lexical_used"),
    )
    return questions.select("query_id", "kb_id").join(per_question, "query_id", "left").na.fill(
        {"total_candidates": 0, "selected_chunks": 0, "top_score": 0.0, "semantic_used": False,
         "lexical_used": False}
    )


def answer_gate(summary: DataFrame, indexed_counts: DataFrame, eval_rule: bool = False) -> DataFrame:
    """Decide per question whether an answer is attempted: insufficient_data, out_of_scope or proceed."""
    lexical_only = ~F.col("semantic_used") & F.col("lexical_used")
    threshold = F.lit(V.LOW_EVIDENCE_THRESHOLD)
    if not eval_rule:
        threshold = F.when(lexical_only, V.LOW_EVIDENCE_THRESHOLD_LEXICAL_ONLY).otherwise(threshold)
    weak = (F.col("selected_chunks") == 0) | (F.col("top_score") < threshold)
    gate = (
        F.when(F.col("indexed_chunks") == 0, "insufficient_data").when(weak, "out_of_scope").otherwise("proceed")
    )
    return (
        summary.join(indexed_counts, "kb_id", "left").na.fill({"indexed_chunks": 0}).withColumn("gate", gate)
    )
