"""Rubric scores of evaluation items. A row holds one executed case with its sources and citations; every
dimension is an expression over that row, so scoring a run never shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import scoring as S
from groundwell.functions import text as T

# dimension: (best score, score that passes)
_LEVELS = {
    "retrieval_source_hit": (1, 1), "evidence_relevance": (2, 1), "answer_groundedness": (2, 2),
    "answer_usefulness": (2, 1), "refusal_quality": (2, 2), "citation_integrity": (2, 2),
}


def with_category_rule(items: DataFrame) -> DataFrame:
    """Add category and its rule: outcome, refusal_statuses, min_cited, must_cite, manual_only."""
    rules = F.create_map(*[x for name, (outcome, statuses, cited, must, manual) in V.CATEGORY_RULES.items() for x in (
        F.lit(name),
        F.struct(
            F.lit(outcome).alias("outcome"),
            (T.strings(statuses) if statuses else F.array().cast("array<string>")).alias("refusal_statuses"),
            F.lit(cited).alias("min_cited"), F.lit(must).alias("must_cite"), F.lit(manual).alias("manual_only"),
        ))])
    named = items.withColumn("category", T.eval_category(F.col("category")))
    return named.withColumn("rule", F.try_element_at(rules, F.col("category"))).select(
        "*", "rule.outcome", "rule.refusal_statuses", "rule.min_cited", "rule.must_cite", "rule.manual_only"
    ).drop("rule")


def _evidence_text(name: str) -> Column:
    parts = F.transform(name, lambda s: F.concat_ws(
        " ", s["document_title"], F.coalesce(s["section"], F.lit("")), s["snippet"]))
    return F.array_join(parts, " ")


def _distinct_documents(name: str) -> Column:
    return F.size(F.array_distinct(F.transform(name, lambda s: s["document_id"])))


def _prepare(items: DataFrame) -> DataFrame:
    """Terms and counts the dimensions share."""
    text = {n: T.strip(F.coalesce(F.col(n), F.lit(""))) for n in ("expected_answer", "expected_hint", "answer")}
    staged = with_category_rule(items).withColumns(text)
    target = F.coalesce(F.nullif("expected_answer", F.lit("")), F.col("expected_hint"))
    return staged.withColumns({
        "source_terms": T.significant_terms(_evidence_text("sources")),
        "cited_terms": T.significant_terms(_evidence_text("citations")),
        "answer_terms": T.significant_terms(F.col("answer")), "hint_terms": T.significant_terms(F.col("expected_hint")),
        "expected_terms": T.significant_terms(F.col("expected_answer")), "target_terms": T.significant_terms(target),
        "has_target": target != "", "cited_documents": _distinct_documents("citations"),
        "source_documents": _distinct_documents("sources"),
    })


def source_hit() -> Column:
    expected, hint = F.col("expected_document_id"), F.col("expected_hint")
    found = F.exists("sources", lambda s: s["document_id"] == expected)
    return (
        F.when(expected.isNotNull(), found)
        .when(hint != "", S.term_coverage(F.col("source_terms"), F.col("hint_terms")) >= 0.6)
        .otherwise(F.size("sources") > 0)
    )


def source_cited() -> Column:
    expected = F.col("expected_document_id")
    return F.coalesce(F.exists("citations", lambda s: s["document_id"] == expected), F.lit(False)) & expected.isNotNull()


def evidence_relevance() -> Column:
    retrieved = S.term_coverage(F.col("source_terms"), F.col("target_terms"))
    cited = S.term_coverage(F.col("cited_terms"), F.col("target_terms"))
    best, hit = F.greatest(retrieved, cited), F.col("source_hit")
    base = (
        F.when(~F.col("has_target"), hit.cast("int"))
        .when((best >= 0.55) & (hit | (cited >= 0.55)), 2).when((best >= 0.25) | hit, 1).otherwise(0)
    )
    few = (F.col("min_cited") > 0) & (F.size("citations") > 0) & (F.col("cited_documents") < F.col("min_cited"))
    uncited = F.col("must_cite") & F.col("expected_document_id").isNotNull() & ~F.col("source_cited")
    return F.when(F.size("sources") == 0, 0).when(few | uncited, F.least(base, F.lit(1))).otherwise(base)


def citation_integrity(limit: int = V.CITATION_LIMIT) -> Column:
    ids = F.transform("citations", lambda x: x["chunk_id"])
    broken = F.exists("citations", lambda x: ~F.exists(
        "sources", lambda s: (s["chunk_id"] == x["chunk_id"]) & (s["document_id"] == x["document_id"])))
    repeated = F.size(F.array_distinct(ids)) < F.size("citations")
    none = F.size("citations") == 0
    return (
        F.when(F.col("outcome") == "refusal", F.when(none, 2).otherwise(0))
        .when(none | broken, 0).when(repeated | (F.size("citations") > limit), 1).otherwise(2)
    )


def groundedness() -> Column:
    usable = F.col("source_hit") | (F.col("top_score") >= V.GROUNDABLE_THRESHOLD)
    return (
        F.when((F.col("status") != "grounded") | (F.size("citations") == 0), 0)
        .when((F.col("integrity_score") == 2) & usable, 2).otherwise(1)
    )


def usefulness_signal() -> Column:
    by_answer = S.lexical_f1(F.col("answer_terms"), F.col("expected_terms"))
    by_hint = S.term_coverage(F.col("answer_terms"), F.col("hint_terms"))
    return F.when(F.col("answer") == "", 0.0).otherwise(F.greatest(by_answer, by_hint))


def usefulness() -> Column:
    signal = F.col("usefulness_signal")
    return (
        F.when(F.col("answer") == "", 0)
        .when(~F.col("has_target"), (F.col("status") == "grounded").cast("int"))
        .when(signal >= 0.65, 2).when(signal >= 0.35, 1).otherwise(0)
    )


def refusal_quality() -> Column:
    matches = F.array_contains("refusal_statuses", F.col("status"))
    clean = (F.length("answer") <= 320) & F.col("answer").rlike(f"(?i)({V.REFUSAL_PATTERN})")
    return (
        F.when((F.col("status") == "grounded") | (F.size("citations") > 0), 0)
        .when(matches & clean, 2).otherwise(1)
    )


def _dimension(name: str, score: Column) -> Column:
    best, passing = _LEVELS[name]
    return F.struct(
        score.isNotNull().alias("applicable"), score.cast("int").alias("score"), F.lit(best).alias("max_score"),
        (score >= passing).alias("passed"),
    )


def score_items(items: DataFrame) -> DataFrame:
    """Score every item: dimensions, score, failure_reasons, passed, review flag and secondary metrics.

    `items`: run_id, case_id, question, expected_answer, expected_document_id, expected_hint, category, status,
    answer, top_score, latency_ms, input_tokens, output_tokens, total_tokens, sources, citations, error.
    An item with an error scores zero as a failed execution, whatever its category was.
    """
    refusal = F.col("outcome") == "refusal"
    staged = _prepare(items).withColumns({
        "source_hit": source_hit(), "source_cited": source_cited(), "integrity_score": citation_integrity(),
        "usefulness_signal": F.when(~refusal, usefulness_signal()).otherwise(0.0),
        "requires_human_review": F.col("manual_only") | ~F.col("has_target"),
    })
    staged = staged.withColumns({
        "hit_score": F.col("source_hit").cast("int"),
        "evidence_score": F.when(~refusal, evidence_relevance()),
        "grounded_score": F.when(~refusal, groundedness()),
        "useful_score": F.when(~refusal, usefulness()),
        "refusal_score": F.when(refusal, refusal_quality()),
    })
    failed = F.col("error").isNotNull()
    zero = {"hit_score": 0, "evidence_score": 0, "grounded_score": 0, "useful_score": 0, "refusal_score": None,
            "integrity_score": 0}
    staged = staged.withColumns({
        n: F.when(failed, F.lit(z).cast("int")).otherwise(F.col(n)).cast("int") for n, z in zero.items()
    }).withColumns({
        "category": F.when(failed, "general").otherwise(F.col("category")),
        "outcome": F.when(failed, "grounded_answer").otherwise(F.col("outcome")),
        "requires_human_review": failed | F.col("requires_human_review"),
        "source_cited": ~failed & F.col("source_cited"),
    })
    w, r = V.EVAL_GROUNDED_WEIGHTS, V.EVAL_REFUSAL_WEIGHTS
    grounded = (
        w["retrieval_source_hit"] * F.col("hit_score") + w["evidence_relevance"] * (F.col("evidence_score") / 2)
        + w["answer_groundedness"] * (F.col("grounded_score") / 2) + w["answer_usefulness"] * (F.col("useful_score") / 2)
        + w["citation_integrity"] * (F.col("integrity_score") / 2)
    )
    refused = r["refusal_quality"] * (F.col("refusal_score") / 2) + r["citation_integrity"] * (F.col("integrity_score") / 2)
    score = F.when(failed, 0.0).otherwise(F.round(F.when(refusal, refused).otherwise(grounded), 4))
    match = F.greatest(S.term_coverage(F.col("source_terms"), F.col("hint_terms")), F.col("usefulness_signal"))
    scored = staged.withColumns({
        "score": score, "failure_reasons": failure_reasons(),
        "answer_match_score": F.when(failed, 0.0).otherwise(F.round(match, 4)),
    })
    refusal_pass = (F.col("refusal_score") == 2) & (F.col("integrity_score") == 2)
    grounded_pass = (F.size("failure_reasons") == 0) & (F.col("score") >= V.EVAL_PASS_THRESHOLD)
    named = dict(zip(V.DIMENSIONS, ["hit_score", "evidence_score", "grounded_score", "useful_score", "refusal_score",
                                    "integrity_score"]))
    dimensions = F.create_map(*[x for n, c in named.items() for x in (F.lit(n), _dimension(n, F.col(c)))])
    return scored.select(
        "run_id", "case_id", "question", "category", "outcome", "status", "latency_ms", "input_tokens", "output_tokens",
        "total_tokens", "score", "failure_reasons", "answer_match_score", "requires_human_review", "source_hit",
        "source_cited", F.coalesce(F.when(failed, False).when(refusal, refusal_pass).otherwise(grounded_pass), F.lit(False))
        .alias("passed"), dimensions.alias("dimensions"),
        F.when(failed, 0.0).otherwise(F.round("top_score", 4)).alias("top_score"),
        F.when(failed, 0).otherwise(F.size("citations")).alias("citation_count"),
        F.when(failed, 0).otherwise(F.size("sources")).alias("source_count"),
        F.when(failed, 0).otherwise(F.col("source_documents")).alias("source_documents"),
        F.when(failed, 0).otherwise(F.col("cited_documents")).alias("cited_documents"),
    )


def failure_reasons() -> Column:
    """Ordered reasons why an item falls short."""
    refusal = F.col("outcome") == "refusal"
    wrong_mode = (
        (F.col("refusal_score") == 1) & ~F.array_contains("refusal_statuses", F.col("status"))
    )
    by_refusal = [
        F.when(F.col("refusal_score") != 2, F.when(wrong_mode, "wrong_refusal_mode").otherwise("incorrect_refusal")),
        F.when(F.col("integrity_score") != 2, F.lit("citation_integrity_failed")),
    ]
    by_answer = [
        F.when(F.col("hit_score") == 0, F.lit("expected_source_missing")),
        F.when(F.col("must_cite") & F.col("expected_document_id").isNotNull() & ~F.col("source_cited"),
               F.lit("expected_source_not_cited")),
        F.when(F.col("evidence_score") < 1, F.lit("weak_evidence_relevance")),
        F.when(F.col("grounded_score") < 2, F.lit("answer_not_grounded")),
        F.when(F.col("useful_score") < 1, F.lit("answer_not_useful")),
        F.when(F.col("integrity_score") < 2, F.lit("citation_integrity_failed")),
        F.when((F.col("min_cited") > 0) & (F.col("cited_documents") < F.col("min_cited")),
               F.lit("missing_multi_source_support")),
    ]
    return (
        F.when(F.col("error").isNotNull(), F.array(F.lit("execution_failed")))
        .when(refusal, F.array_compact(F.array(*by_refusal))).otherwise(F.array_compact(F.array(*by_answer)))
    )
