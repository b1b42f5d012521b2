"""An evaluation run as one plan: retrieve, gate, answer, cite, score, summarize."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import citations as X
from groundwell.operators import evaluation as E
from groundwell.operators import reporting as P
from groundwell.operators.index import ChunkIndex
from groundwell.plans import retrieve as R
from groundwell.sources.tables import settle

_KEPT = [
    "query_id", "chunk_id", "doc_id", "version_id", "chunk_no", "content", "search_text", "section_title", "page_number",
    "document_title", "hybrid_score", "retrieved_by", "rank_after_dedup",
]


def execute_cases(
    cases: DataFrame, question_vectors: DataFrame, index: ChunkIndex, as_of: Column, run_id: str,
    candidate_limit: int = V.CANDIDATE_LIMIT, grounding_limit: int = V.GROUNDING_LIMIT, usage: DataFrame | None = None,
) -> DataFrame:
    """Run every case (query_id, kb_id, question, filters, expectations): one scored-to-be item per case.
    Candidates and answers are written once to the shared folder, because later steps read them several times.
    `usage` (case_id, latency_ms, input_tokens, output_tokens, total_tokens, error) is what the answering of each case took and how
    it failed, if it did; a case without a row counts as 0 and not failed."""
    found = settle(
        R.retrieve(cases, question_vectors, index, as_of, candidate_limit, candidate_limit).select(*_KEPT),
        "retrieved",
    )
    ground = R.grounding(found, grounding_limit).select(
        "query_id", "chunk_id", "doc_id", "version_id", "chunk_no", "content", "search_text", "section_title",
        "page_number", "document_title", "hybrid_score", F.col("rank_after_dedup").alias("grounding_rank"),
    )
    prepared = T.preprocess(cases)
    counts = index.chunks.groupBy("kb_id").agg(F.count("*").alias("indexed_chunks"))
    gated = R.answer_gate(R.retrieval_summary(cases, found, grounding_limit), counts, eval_rule=True)
    answers = settle(X.compose_answers(prepared, ground), "answers")
    asked = answers.filter("status = 'grounded'").select("query_id", F.col("answer").alias("answer_text"), "used_chunk_ids")
    asked = asked.join(prepared.select("query_id", F.col("tokens").alias("query_terms"), "phrases"), "query_id")
    cited = X.select_citations(X.prepare_citations(asked, ground))
    source = F.struct(
        "position", "chunk_id", F.col("doc_id").alias("document_id"), "document_title",
        F.col("section_title").alias("section"), "snippet",
    )
    sources = ground.withColumn("position", F.col("grounding_rank")).withColumn(
        "snippet", T.evidence_snippet(F.col("content"))
    ).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    kept = cited.withColumn("position", F.col("citation_rank")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("citation_rank").isNotNull(), source))).alias("citations")
    )
    none = F.array().cast(sources.schema["sources"].dataType)
    joined = (
        cases.join(gated.select("query_id", "gate", "top_score"), "query_id").join(answers, "query_id")
        .join(sources, "query_id", "left").join(kept, "query_id", "left")
        .withColumn("sources", F.coalesce("sources", none)).withColumn("citations", F.coalesce("citations", none))
    )
    proceeds = F.col("gate") == "proceed"
    bare = proceeds & (F.col("status") == "grounded") & (F.size("citations") == 0)
    status = F.when(~proceeds, F.col("gate")).when(bare, "insufficient_data").otherwise(F.col("status"))
    answer = (
        F.when(F.col("gate") == "insufficient_data", V.NOT_INDEXED_ANSWER)
        .when(F.col("gate") == "out_of_scope", V.NO_SUPPORT_ANSWER)
        .when(bare, V.NO_CITATION_ANSWER).otherwise(F.col("answer"))
    )
    spent = {n: F.lit(0) for n in ("latency_ms", "input_tokens", "output_tokens", "total_tokens")} | {"error": F.lit(None).cast("string")}
    if usage is not None:
        joined = joined.join(usage.select(F.col("case_id").alias("query_id"), F.struct(*spent).alias("used")), "query_id", "left")
        spent = {n: F.coalesce(F.col(f"used.{n}"), none_yet) for n, none_yet in spent.items()}
    return joined.select(
        F.lit(run_id).alias("run_id"), F.col("query_id").alias("case_id"), "question", "expected_answer",
        "expected_document_id", "expected_hint", "category", status.alias("status"), answer.alias("answer"), "top_score",
        *[spent[n].alias(n) for n in ("latency_ms", "input_tokens", "output_tokens", "total_tokens")], F.when(proceeds, F.col("sources")).otherwise(none).alias("sources"),
        F.when(proceeds, F.col("citations")).otherwise(none).alias("citations"), spent["error"].alias("error"),
    )


def run_eval(*args, **kwargs) -> DataFrame:
    """Scored items of one run."""
    return E.score_items(execute_cases(*args, **kwargs))


@dataclass(frozen=True)
class EvalRun:
    """What a finished run leaves: its items with their regression flags, and the reports made of them."""

    items: DataFrame
    summary: DataFrame
    deltas: DataFrame
    changes: DataFrame
    regressions: DataFrame


def finish_run(items: DataFrame, runs: DataFrame, earlier: DataFrame | None = None) -> EvalRun:
    """Flags, summary, differences and notable regressions of the run that `items` (scored) belong to.

    `runs` (run_id, eval_set_id, started_us or started_at, status) names all runs of the sets; `earlier` are the scored items of the
    runs before, of which only the previous one of the same set is compared. Without it nothing is a regression."""
    own = settle(items, "eval-items")
    every = own if earlier is None else own.unionByName(earlier.select(*own.columns))
    this = own.select("run_id").distinct()
    flagged = P.regression_flags(P.items_with_previous(every, runs)).join(this, "run_id", "left_semi")
    flagged = settle(flagged, "eval-flagged")
    summaries = P.run_summary(every)
    deltas = P.run_deltas(summaries, runs).join(this, "run_id", "left_semi")
    return EvalRun(flagged, summaries.join(this, "run_id", "left_semi"), deltas, P.meaningful_changes(deltas), P.notable_regressions(flagged))
