"""Run summaries and run-over-run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V

RATES = {
    "retrieval_hit_rate": "retrieval_source_hit", "evidence_relevance_rate": "evidence_relevance",
    "groundedness_rate": "answer_groundedness", "usefulness_rate": "answer_usefulness",
    "refusal_correctness_rate": "refusal_quality", "citation_integrity_rate": "citation_integrity",
}
DELTAS = [
    "pass_rate", "retrieval_hit_rate", "groundedness_rate", "refusal_correctness_rate", "citation_integrity_rate",
    "average_latency_ms", "average_score", "regression_count",
]
CHANGES = [
    "pass_rate", "retrieval_hit_rate", "groundedness_rate", "refusal_correctness_rate", "citation_integrity_rate",
    "average_score",
]


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def _dimension(name: str) -> Column:
    return F.try_element_at("dimensions", F.lit(name))


def _held(dimension: Column) -> Column:
    """Passed, and applicable at all."""
    return F.coalesce(dimension["applicable"] & dimension["passed"], F.lit(False))


def run_summary(items: DataFrame) -> DataFrame:
    """One row per run: counts, rates, means and token totals, in one aggregation."""
    total = F.count("*")
    rates = {
        rate: _rate(F.count_if(_held(_dimension(d))), F.count_if(_dimension(d)["applicable"]))
        for rate, d in RATES.items()
    }
    flag = F.col("regression_flag") if "regression_flag" in items.columns else F.lit(False)
    return items.groupBy("run_id").agg(
        total.alias("total_cases"), F.count_if("passed").alias("passed_cases"),
        _rate(F.count_if("passed"), total).alias("pass_rate"), *[c.alias(n) for n, c in rates.items()],
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("average_latency_ms"),
        F.round(F.avg("score"), 4).alias("average_score"), F.count_if(flag).alias("regression_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.round(F.avg("total_tokens"), 2).alias("average_tokens"),
    )


def dimension_rates(items: DataFrame) -> DataFrame:
    rows = items.select("run_id", F.explode("dimensions").alias("dimension", "d"))
    applicable, passed = F.count_if("d.applicable"), F.count_if(_held(F.col("d")))
    return rows.groupBy("run_id", "dimension").agg(
        applicable.alias("applicable_cases"), passed.alias("passed_cases"), _rate(passed, applicable).alias("rate")
    )


def status_breakdown(items: DataFrame) -> DataFrame:
    """Execution status counts per run as a map; statuses are few, so the second grouping is small."""
    counts = items.groupBy("run_id", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts")
    )


def failure_reason_counts(items: DataFrame) -> DataFrame:
    return items.select("run_id", F.explode("failure_reasons").alias("reason")).groupBy("run_id", "reason").agg(
        F.count("*").alias("items")
    )


def category_breakdown(items: DataFrame) -> DataFrame:
    total, passed = F.count("*"), F.count_if("passed")
    return items.groupBy("run_id", "category").agg(
        total.alias("total_cases"), passed.alias("passed_cases"), _rate(passed, total).alias("pass_rate")
    )


def previous_runs(runs: DataFrame) -> DataFrame:
    """Latest completed run of the same set that started earlier."""
    order = Window.partitionBy("eval_set_id").orderBy("started_us")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("status") == "COMPLETED", F.col("run_id")), ignorenulls=True)
    rows = runs if "started_us" in runs.columns else runs.withColumn("started_us", F.unix_micros("started_at"))
    return rows.withColumn("previous_run_id", last.over(before))


_PREVIOUS = ["passed", "score", "status", "dimensions"]


def items_with_previous(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items left joined to the same case in the previous run of their set (columns previous_*)."""
    linked = items.join(previous_runs(runs).select("run_id", "previous_run_id"), "run_id", "left")
    earlier = items.select(
        F.col("run_id").alias("previous_run_id"), "case_id", *[F.col(c).alias(f"previous_{c}") for c in _PREVIOUS]
    )
    return linked.join(earlier, ["previous_run_id", "case_id"], "left")


def _flipped(name: str) -> Column:
    before = F.try_element_at("previous_dimensions", F.lit(name))["passed"]
    return F.coalesce(before & ~_dimension(name)["passed"], F.lit(False))


def regression_flags(compared: DataFrame) -> DataFrame:
    """Add regression_flag: passed before and not now, score down by 0.2, or a critical dimension lost."""
    lost = F.lit(False)
    for name in V.CRITICAL_DIMENSIONS:
        lost = lost | _flipped(name)
    flag = (
        (F.col("previous_passed") & ~F.col("passed")) | (F.col("previous_score") - F.col("score") >= 0.2) | lost
    )
    return compared.withColumn(
        "regression_flag", F.col("previous_passed").isNotNull() & F.coalesce(flag, F.lit(False))
    )


def stored_dimensions(stored: Column) -> Column:
    """Dimensions of a stored item's JSON, with fallbacks for items written before dimensions were kept."""
    def at(path: str) -> Column:
        return F.get_json_object(stored, f"$.{path}")

    refusal = F.coalesce(at("breakdown.expectedOutcome") == "refusal", F.lit(False))
    citations = F.coalesce(
        F.json_array_length(at("citations")), F.json_array_length(at("citationChunkIds")), F.lit(0)
    )
    grounded = F.coalesce(at("status") == "grounded", F.lit(False))
    match = F.coalesce(at("breakdown.answerMatchScore").try_cast("double"), F.lit(0.0))
    hit = F.coalesce(at("breakdown.sourceHit") == "true", F.lit(False))
    legacy = {
        "retrieval_source_hit": hit, "evidence_relevance": hit,
        "answer_groundedness": F.coalesce(at("breakdown.grounded") == "true", F.lit(False)),
        "answer_usefulness": match >= 0.45,
        "refusal_quality": F.coalesce(at("breakdown.correctRefusal") == "true", F.lit(False)),
        "citation_integrity": F.when(grounded, citations > 0).otherwise(citations == 0),
    }

    def read(name: str) -> Column:
        passed, applies = at(f"breakdown.dimensions.{name}.passed"), at(f"breakdown.dimensions.{name}.applicable")
        applicable = F.coalesce(applies.try_cast("boolean"), refusal if name == "refusal_quality" else ~refusal)
        best = 1 if name == "retrieval_source_hit" else 2
        held = F.coalesce(passed.try_cast("boolean"), legacy[name])
        return F.struct(
            applicable.alias("applicable"), F.when(applicable, F.when(held, best).otherwise(0)).alias("score"),
            F.lit(best).alias("max_score"), held.alias("passed"),
        )

    return F.create_map(*[x for n in V.DIMENSIONS for x in (F.lit(n), read(n))])


def run_deltas(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Differences of every run to the previous run of its set; runs without one are left out."""
    linked = summaries.join(previous_runs(runs).select("run_id", "previous_run_id"), "run_id").filter(
        "previous_run_id IS NOT NULL"
    )
    before = summaries.select(
        F.col("run_id").alias("previous_run_id"), F.col("total_cases").alias("previous_total_cases"),
        *[F.col(c).alias(f"previous_{c}") for c in DELTAS],
    )
    return linked.join(before, "previous_run_id").select(
        "run_id", "previous_run_id", "total_cases", "previous_total_cases", "previous_average_latency_ms",
        *[F.round(F.col(c) - F.col(f"previous_{c}"), 4).alias(f"{c}_delta") for c in DELTAS],
    )


def meaningful_changes(deltas: DataFrame) -> DataFrame:
    """(run_id, metric, direction, delta, threshold) for deltas at or above their threshold."""
    cases = F.greatest("total_cases", "previous_total_cases", F.lit(1))
    rate_threshold = F.round(F.greatest(F.lit(0.05), 1 / cases), 4)
    latency_threshold = F.round(F.greatest(F.lit(250.0), F.col("previous_average_latency_ms") * 0.2), 4)
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_delta").alias("delta"), rate_threshold.alias("threshold"))
        for m in CHANGES
    ] + [F.struct(F.lit("average_latency_ms").alias("metric"), F.col("average_latency_ms_delta").alias("delta"),
                  latency_threshold.alias("threshold"))]
    rows = deltas.select("run_id", F.inline(F.array(*entries))).filter(F.abs("delta") >= F.col("threshold"))
    better = F.when(F.col("metric") == "average_latency_ms", F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return rows.withColumn("direction", F.when(better, "improved").otherwise("regressed"))


def notable_regressions(flagged: DataFrame, limit: int = 10) -> DataFrame:
    """The worst regressions of a run: those that passed before first, then the largest drop."""
    changed = F.filter(
        F.array(*[F.when(_flipped(d), F.lit(d)) for d in V.DIMENSIONS]), lambda x: x.isNotNull()
    )
    rows = flagged.select(
        "run_id", "case_id", "previous_passed", "passed", "regression_flag",
        F.round(F.col("score") - F.col("previous_score"), 4).alias("score_delta"), changed.alias("changed_dimensions"),
    )
    order = Window.partitionBy("run_id", "regression_flag").orderBy(
        F.desc("previous_passed"), F.asc("score_delta"), F.asc("case_id")
    )
    return rows.withColumn("position", F.row_number().over(order)).filter(
        (F.col("position") <= limit) & F.col("regression_flag")
    ).drop("regression_flag")


def reconstruct_summaries(stored_items: DataFrame, stored_summaries: DataFrame) -> DataFrame:
    """Pass rate and dimension rates of runs: the stored summary where it is whole, else from stored items."""
    items = stored_items.withColumn("dimensions", stored_dimensions(F.col("stored")))
    rebuilt = run_summary(items).select("run_id", "total_cases", "pass_rate", *RATES)
    names = ["pass_rate", "retrieval_hit_rate", "groundedness_rate", "refusal_correctness_rate", "citation_integrity_rate"]
    spelled = {"pass_rate": "passRate", "retrieval_hit_rate": "retrievalHitRate", "groundedness_rate": "groundednessRate",
               "refusal_correctness_rate": "refusalCorrectnessRate", "citation_integrity_rate": "citationIntegrityRate"}
    parsed = stored_summaries.select("run_id", *[
        F.get_json_object("summary", f"$.{spelled[n]}").try_cast("double").alias(f"kept_{n}") for n in names])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"kept_{n}").isNotNull()
    return rebuilt.join(parsed, "run_id", "left").select(
        "run_id", "total_cases", *[F.when(whole, F.col(f"kept_{n}")).otherwise(F.col(n)).alias(n) for n in names],
        (~whole).alias("reconstructed"),
    )
