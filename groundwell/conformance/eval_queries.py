"""E, G12-G16, J07, J08: evaluation items, rubric, summaries, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.conformance import answer_queries as A
from groundwell.conformance import sqlviews as Q
from groundwell.conformance.registry import query
from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import evaluation as E
from groundwell.operators import reporting as P
from groundwell.plans import evaluate
from groundwell.sources.tables import settle

_CATEGORIES = ["single source", "multi_source", "general", "out_of_scope", "refusal", "version_sensitive", "access_sensitive", "insufficient"]
_REFUSAL = "I could not find relevant support material."


def items(c):
    """Two runs over the questions: run 2 as retrieved, run 1 with fewer sources and a worse answer."""
    source = F.struct(
        F.col("grounding_rank").alias("position"), "chunk_id", F.col("doc_id").alias("document_id"), "document_title",
        F.col("section_title").alias("section"), T.evidence_snippet(F.col("content")).alias("snippet"))
    listed = A.ground(c).groupBy("query_id").agg(
        F.array_sort(F.collect_list(source)).alias("all_sources"),
        F.array_sort(F.collect_list(F.struct("grounding_rank", "search_text", "doc_id", "hybrid_score"))).alias("g"))
    rows = listed.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    q = F.col("query_id")
    category = F.get(T.strings(_CATEGORIES), (q % 8).cast("int"))
    refuses = category.isin("out_of_scope", "refusal", "insufficient")
    status = F.when(refuses, F.when(q % 3 == 0, "grounded").otherwise("out_of_scope")).otherwise(
        F.when(q % 7 == 0, "insufficient_data").otherwise("grounded"))
    text = lambda n: F.coalesce(F.get("g", F.lit(n))["search_text"], F.lit(""))
    answer = F.when(status == "grounded", F.substring(F.when(F.col("run") == 2, text(0)).otherwise(text(2)), 1, 150)).otherwise(_REFUSAL)
    cited = F.when(status == "grounded", F.slice("all_sources", F.lit(1), F.col("run") + 1)).otherwise(F.slice("all_sources", 1, 0))
    return rows.select(
        F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"), q.alias("case_id"), F.lit("").alias("question"),
        F.when(q % 3 == 2, F.substring(text(0), 1, 120)).alias("expected_answer"),
        F.when(q % 2 == 0, F.get("g", (q % 4).cast("int"))["doc_id"]).alias("expected_document_id"),
        F.when(q % 3 == 1, F.substring(text(1), 1, 60)).alias("expected_hint"), category.alias("category"),
        status.alias("status"), answer.alias("answer"), F.get("g", F.lit(0))["hybrid_score"].alias("top_score"),
        (100 + q * 13 % 400 + F.col("run") * 300 * (q % 2)).alias("latency_ms"), (q * 10).alias("input_tokens"),
        (q * 5).alias("output_tokens"), (q * 15).alias("total_tokens"),
        F.slice("all_sources", F.lit(1), F.col("run") * 2 + 2).alias("sources"), cited.alias("citations"),
        F.when((q % 11 == 5) & (F.col("run") == 2), "boom").alias("error"))


def scored(c):
    return E.score_items(items(c))


def runs(c):
    """Run headers: two runs of one set and a failed one between them."""
    rows = c.questions.select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("n")).distinct()
    return rows.select(
        F.concat(F.lit("run-"), F.when(F.col("n") == 3, "x").otherwise(F.col("n").cast("string"))).alias("run_id"),
        F.lit("set-1").alias("eval_set_id"), F.when(F.col("n") == 3, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(F.col("n") == 3, 15).otherwise(F.col("n") * 10).cast("long").alias("started_us"))


def compared(c):
    return P.regression_flags(P.items_with_previous(scored(c), runs(c)))


_CAT_SQL = Q.sql_list(_CATEGORIES)
VIEWS = {
    **A.VIEWS,
    "listed": f"""
        SELECT query_id AS q, list({{'chunk_id': chunk_id, 'document_id': doc_id, 'text': document_title || ' ' || coalesce(section_title, '') || ' '
            || left({Q.collapse('content')}, 280)}} ORDER BY grounding_rank) AS all_sources, list(search_text ORDER BY grounding_rank) AS texts,
          list(doc_id ORDER BY grounding_rank) AS docs, max(hybrid_score) AS top_score FROM ground GROUP BY query_id""",
    "item0": f"""
        SELECT *, 'run-' || run AS run_id, {_CAT_SQL}[1 + q % 8] AS raw_category, unnest([1]) AS one,
          CASE WHEN q % 8 IN (3, 4, 7) THEN CASE WHEN q % 3 = 0 THEN 'grounded' ELSE 'out_of_scope' END
               WHEN q % 7 = 0 THEN 'insufficient_data' ELSE 'grounded' END AS status
        FROM (SELECT *, unnest([1, 2]) AS run FROM listed)""",
    "item": f"""
        SELECT run_id, run, q, q AS case_id, status, top_score, list_slice(all_sources, 1, run * 2 + 2) AS sources,
          CASE WHEN status = 'grounded' THEN list_slice(all_sources, 1, run + 1) ELSE [] END AS citations,
          trim(CASE WHEN status = 'grounded' THEN left(coalesce(CASE WHEN run = 2 THEN texts[1] ELSE texts[3] END, ''), 150) ELSE '{_REFUSAL}' END) AS answer,
          trim(CASE WHEN q % 3 = 2 THEN left(texts[1], 120) ELSE '' END) AS expected_answer,
          trim(CASE WHEN q % 3 = 1 THEN left(coalesce(texts[2], ''), 60) ELSE '' END) AS expected_hint,
          CASE WHEN q % 2 = 0 THEN docs[1 + q % 4] END AS expected_doc, 100 + q * 13 % 400 + run * 300 * (q % 2) AS latency_ms,
          q % 11 = 5 AND run = 2 AS failed,
          CASE q % 8 WHEN 0 THEN 'single_source_factual' WHEN 1 THEN 'multi_source_synthesis' WHEN 2 THEN 'general' WHEN 3 THEN 'out_of_scope'
            WHEN 4 THEN 'refusal' WHEN 5 THEN 'version_recency_sensitive' WHEN 6 THEN 'access_sensitive' ELSE 'insufficient_data' END AS case_category,
          q % 8 IN (3, 4, 7) AS refuses, q % 8 = 1 AS multi, q % 8 = 5 AS must_cite, q % 8 = 6 AS manual
        FROM item0""",
    "item_terms": f"""
        SELECT *, {Q.significant("array_to_string(list_transform(sources, lambda s: s.text), ' ')")} AS st,
          {Q.significant("array_to_string(list_transform(citations, lambda s: s.text), ' ')")} AS ct, {Q.significant('answer')} AS ans_t,
          {Q.significant('expected_answer')} AS et, {Q.significant('expected_hint')} AS ht,
          {Q.significant("CASE WHEN expected_answer <> '' THEN expected_answer ELSE expected_hint END")} AS tt,
          expected_answer <> '' OR expected_hint <> '' AS has_target,
          len(list_distinct(list_transform(citations, lambda s: s.document_id))) AS cited_docs,
          len(list_distinct(list_transform(sources, lambda s: s.document_id))) AS source_docs FROM item""",
    "item_cov": f"""
        SELECT *, {Q.share("len(list_filter(ht, lambda w: list_contains(st, w)))", 'len(ht)')} AS hint_cov,
          {Q.share("len(list_filter(tt, lambda w: list_contains(st, w)))", 'len(tt)')} AS ret_cov,
          {Q.share("len(list_filter(tt, lambda w: list_contains(ct, w)))", 'len(tt)')} AS cit_cov,
          {Q.share("len(list_filter(ht, lambda w: list_contains(ans_t, w)))", 'len(ht)')} AS ans_hint,
          len(list_filter(list_distinct(ans_t), lambda w: list_contains(et, w))) AS overlap,
          coalesce(len(list_filter(citations, lambda s: s.document_id = expected_doc)) > 0, false) AS cited_expected FROM item_terms""",
    "item_hit": """
        SELECT *, CASE WHEN expected_doc IS NOT NULL THEN len(list_filter(sources, lambda s: s.document_id = expected_doc)) > 0
              WHEN expected_hint <> '' THEN hint_cov >= 0.6 ELSE len(sources) > 0 END AS hit,
          CASE WHEN refuses OR answer = '' THEN 0.0::DOUBLE ELSE greatest(CASE WHEN overlap > 0 THEN 2.0::DOUBLE * overlap
              / (len(list_distinct(ans_t)) + len(list_distinct(et))) ELSE 0 END, ans_hint) END AS signal,
          CASE WHEN refuses THEN CASE WHEN len(citations) = 0 THEN 2 ELSE 0 END WHEN len(citations) = 0 THEN 0
              WHEN len(citations) > 3 THEN 1 ELSE 2 END AS integrity FROM item_cov""",
    "item_dims": f"""
        SELECT *, CASE WHEN refuses THEN NULL WHEN len(sources) = 0 THEN 0 WHEN (multi AND len(citations) > 0 AND cited_docs < 2)
              OR (must_cite AND expected_doc IS NOT NULL AND NOT cited_expected) THEN least(1, ev) ELSE ev END AS evidence,
          CASE WHEN refuses THEN NULL WHEN status <> 'grounded' OR len(citations) = 0 THEN 0
              WHEN integrity = 2 AND (hit OR top_score >= 0.2) THEN 2 ELSE 1 END AS grounded,
          CASE WHEN refuses THEN NULL WHEN answer = '' THEN 0 WHEN NOT has_target THEN CASE WHEN status = 'grounded' THEN 1 ELSE 0 END
              WHEN signal >= 0.65 THEN 2 WHEN signal >= 0.35 THEN 1 ELSE 0 END AS useful,
          CASE WHEN NOT refuses THEN NULL WHEN status = 'grounded' OR len(citations) > 0 THEN 0
              WHEN (case_category IN ('out_of_scope', 'refusal') AND status = 'out_of_scope') AND length(answer) <= 320
                   AND regexp_matches(answer, '(?i)({V.REFUSAL_PATTERN.replace("'", "''")})') THEN 2 ELSE 1 END AS refusal
        FROM (SELECT *, CASE WHEN NOT has_target THEN CASE WHEN hit THEN 1 ELSE 0 END
                WHEN greatest(ret_cov, cit_cov) >= 0.55 AND (hit OR cit_cov >= 0.55) THEN 2
                WHEN greatest(ret_cov, cit_cov) >= 0.25 OR hit THEN 1 ELSE 0 END AS ev FROM item_hit)""",
    "item_final": """
        SELECT run_id, case_id, status, latency_ms, q, top_score, citations, sources, cited_docs, source_docs, has_target, manual, failed,
          CASE WHEN failed THEN 'general' ELSE case_category END AS category, refuses AND NOT failed AS refuses,
          CASE WHEN failed THEN 0 WHEN hit THEN 1 ELSE 0 END AS hit_score, CASE WHEN failed THEN 0 ELSE evidence END AS evidence,
          CASE WHEN failed THEN 0 ELSE grounded END AS grounded, CASE WHEN failed THEN 0 ELSE useful END AS useful,
          CASE WHEN failed THEN NULL ELSE refusal END AS refusal, CASE WHEN failed THEN 0 ELSE integrity END AS integrity,
          NOT failed AND cited_expected AS source_cited, CASE WHEN failed THEN 0.0::DOUBLE ELSE round(greatest(hint_cov, signal), 4) END AS answer_match_score,
          CASE WHEN failed THEN ['execution_failed'] WHEN refuses THEN list_filter([
              CASE WHEN refusal <> 2 THEN CASE WHEN refusal = 1 AND NOT (case_category IN ('out_of_scope', 'refusal') AND status = 'out_of_scope')
                   THEN 'wrong_refusal_mode' ELSE 'incorrect_refusal' END END,
              CASE WHEN integrity <> 2 THEN 'citation_integrity_failed' END], lambda x: x IS NOT NULL)
            ELSE list_filter([CASE WHEN NOT hit THEN 'expected_source_missing' END,
              CASE WHEN must_cite AND expected_doc IS NOT NULL AND NOT cited_expected THEN 'expected_source_not_cited' END,
              CASE WHEN evidence < 1 THEN 'weak_evidence_relevance' END, CASE WHEN grounded < 2 THEN 'answer_not_grounded' END,
              CASE WHEN useful < 1 THEN 'answer_not_useful' END, CASE WHEN integrity < 2 THEN 'citation_integrity_failed' END,
              CASE WHEN multi AND cited_docs < 2 THEN 'missing_multi_source_support' END], lambda x: x IS NOT NULL) END AS reasons
        FROM item_dims""",
    "eval_item": """
        SELECT *, CASE WHEN failed THEN false WHEN refuses THEN refusal = 2 AND integrity = 2 ELSE len(reasons) = 0 AND score >= 0.7 END AS passed
        FROM (SELECT *, CASE WHEN failed THEN 0.0::DOUBLE ELSE round(CASE WHEN refuses THEN 0.7::DOUBLE * refusal / 2 + 0.3::DOUBLE * integrity / 2
            ELSE 0.25::DOUBLE * hit_score + 0.15::DOUBLE * evidence / 2 + 0.25::DOUBLE * grounded / 2 + 0.25::DOUBLE * useful / 2
              + 0.1::DOUBLE * integrity / 2 END, 4) END AS score FROM item_final)""",
    "eval_pair": """
        SELECT c.*, p.case_id IS NOT NULL AS has_previous, p.passed AS p_passed, p.score AS p_score, p.hit_score AS p_hit, p.evidence AS p_evidence,
          p.grounded AS p_grounded, p.useful AS p_useful, p.refusal AS p_refusal, p.integrity AS p_integrity
        FROM eval_item c LEFT JOIN eval_item p ON c.run_id = 'run-2' AND p.run_id = 'run-1' AND p.case_id = c.case_id""",
    "eval_flag": """
        SELECT *, has_previous AND coalesce((p_passed AND NOT passed) OR p_score - score >= 0.2::DOUBLE OR coalesce(p_hit >= 1 AND hit_score < 1, false)
          OR coalesce(p_grounded >= 2 AND grounded < 2, false) OR coalesce(p_refusal >= 2 AND refusal < 2, false)
          OR coalesce(p_integrity >= 2 AND integrity < 2, false), false) AS flag FROM eval_pair""",
    "run_sum": """
        SELECT run_id, count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases, round(count(*) FILTER (passed) / count(*)::DOUBLE, 4) AS pass_rate,
          round(count(*) FILTER (hit_score >= 1) / count(*)::DOUBLE, 4) AS retrieval_hit_rate,
          coalesce(round(count(*) FILTER (grounded >= 2) / nullif(count(grounded), 0)::DOUBLE, 4), 0) AS groundedness_rate,
          coalesce(round(count(*) FILTER (refusal >= 2) / nullif(count(refusal), 0)::DOUBLE, 4), 0) AS refusal_correctness_rate,
          round(count(*) FILTER (integrity >= 2) / count(*)::DOUBLE, 4) AS citation_integrity_rate, round(avg(latency_ms), 2) AS average_latency_ms,
          round(avg(score), 4) AS average_score, count(*) FILTER (flag) AS regression_count, sum(q * 15)::BIGINT AS total_tokens
        FROM eval_flag GROUP BY run_id""",
    "run_delta": """
        SELECT a.run_id, greatest(a.total_cases, b.total_cases) AS cases, b.average_latency_ms AS prev_latency,
          round(a.pass_rate - b.pass_rate, 4) AS pass_rate, round(a.retrieval_hit_rate - b.retrieval_hit_rate, 4) AS retrieval_hit_rate,
          round(a.groundedness_rate - b.groundedness_rate, 4) AS groundedness_rate,
          round(a.refusal_correctness_rate - b.refusal_correctness_rate, 4) AS refusal_correctness_rate,
          round(a.citation_integrity_rate - b.citation_integrity_rate, 4) AS citation_integrity_rate,
          round(a.average_latency_ms - b.average_latency_ms, 4) AS average_latency_ms, round(a.average_score - b.average_score, 4) AS average_score,
          a.regression_count - b.regression_count AS regression_count
        FROM run_sum a JOIN run_sum b ON a.run_id = 'run-2' AND b.run_id = 'run-1'""",
}


def _score(name, column):
    return F.coalesce(F.col("dimensions")[name]["score"], F.lit(-1)).cast("long").alias(column)


def _dimension_query(key, dimension, column):
    @query(key, f"SELECT run_id, case_id, coalesce({column}, -1)::BIGINT AS {column} FROM eval_item", VIEWS)
    def _(c):
        return scored(c).select("run_id", "case_id", _score(dimension, column))


def _field_query(key, sql_column, build, name):
    @query(key, f"SELECT run_id, case_id, {sql_column} AS {name} FROM eval_item", VIEWS)
    def _(c):
        return scored(c).select("run_id", "case_id", build().alias(name))


_dimension_query("e01_source_hit", "retrieval_source_hit", "hit_score")
_field_query("e02_source_cited", "source_cited", lambda: F.col("source_cited"), "source_cited")
_dimension_query("e03_evidence_relevance", "evidence_relevance", "evidence")
_dimension_query("e04_groundedness", "answer_groundedness", "grounded")
_dimension_query("e05_answer_usefulness", "answer_usefulness", "useful")
_dimension_query("e06_refusal_quality", "refusal_quality", "refusal")
_dimension_query("e07_citation_integrity", "citation_integrity", "integrity")
_field_query("e08_not_applicable", "(refusal IS NULL)", lambda: ~F.col("dimensions")["refusal_quality"]["applicable"], "refusal_not_applicable")
_field_query("e09_case_score", "score", lambda: F.col("score"), "score")
_field_query("e10_failure_reasons", "array_to_string(reasons, '|')", lambda: F.array_join("failure_reasons", "|"), "reasons")
_field_query("e11_case_verdict", "passed", lambda: F.col("passed"), "passed")
_field_query("e12_human_review_flag", "(failed OR manual OR NOT has_target)", lambda: F.col("requires_human_review"), "review")


@query("e13_secondary_metrics", """
    SELECT run_id, case_id, CASE WHEN failed THEN 0 ELSE len(citations) END AS citation_count, CASE WHEN failed THEN 0 ELSE len(sources) END AS source_count,
      CASE WHEN failed THEN 0 ELSE source_docs END AS source_documents, CASE WHEN failed THEN 0 ELSE cited_docs END AS cited_documents,
      answer_match_score FROM eval_item""", VIEWS)
def _(c):
    names = ["citation_count", "source_count", "source_documents", "cited_documents"]
    return scored(c).select("run_id", "case_id", *[F.col(n).cast("long").alias(n) for n in names], "answer_match_score")


@query("e14_score_case", """
    SELECT run_id, case_id, category, score, passed, array_to_string(reasons, '|') AS reasons, hit_score::BIGINT AS hit_score FROM eval_item""", VIEWS)
def _(c):
    return scored(c).select("run_id", "case_id", "category", "score", "passed", F.array_join("failure_reasons", "|").alias("reasons"),
                            _score("retrieval_source_hit", "hit_score"))


@query("e15_regression_flag", "SELECT run_id, case_id, flag FROM eval_flag", VIEWS)
def _(c):
    return compared(c).select("run_id", "case_id", F.col("regression_flag").alias("flag"))


def stored_json(c):
    """Items as an older writer stored them: every second one without dimensions."""
    dims = F.struct(*[F.struct(
        F.col("dimensions")[d]["applicable"].alias("applicable"), F.col("dimensions")[d]["passed"].alias("passed")).alias(d) for d in V.DIMENSIONS])
    new = F.to_json(F.struct("status", F.struct(dims.alias("dimensions"), F.col("outcome").alias("expectedOutcome")).alias("breakdown")))
    old = F.to_json(F.struct("status", F.array_repeat(F.lit("c"), F.col("citation_count")).alias("citationChunkIds"), F.struct(
        F.col("source_hit").alias("sourceHit"), F.col("passed").alias("grounded"), F.lit(False).alias("correctRefusal"),
        F.col("answer_match_score").alias("answerMatchScore"), F.col("outcome").alias("expectedOutcome")).alias("breakdown")))
    return scored(c).withColumn("stored", F.when(F.col("case_id") % 2 == 0, new).otherwise(old))


@query("e16_stored_dimension", """
    SELECT run_id, case_id, CASE WHEN case_id % 2 = 0 THEN coalesce(grounded >= 2, false) ELSE passed END AS grounded_passed,
      CASE WHEN case_id % 2 = 0 THEN integrity >= 2 WHEN status = 'grounded' THEN n > 0 ELSE n = 0 END AS integrity_passed, refuses AS refusal_applicable
    FROM (SELECT *, CASE WHEN failed THEN 0 ELSE len(citations) END AS n FROM eval_item)""", VIEWS)
def _(c):
    rows = stored_json(c).select("run_id", "case_id", P.stored_dimensions(F.col("stored")).alias("d"))
    return rows.select("run_id", "case_id", F.col("d")["answer_groundedness"]["passed"].alias("grounded_passed"),
                       F.col("d")["citation_integrity"]["passed"].alias("integrity_passed"),
                       F.col("d")["refusal_quality"]["applicable"].alias("refusal_applicable"))


@query("e17_execution_failed_item", """
    SELECT run_id, case_id, category, score, array_to_string(reasons, '|') AS reasons FROM eval_item WHERE failed""", VIEWS)
def _(c):
    return E.score_items(items(c).filter("error IS NOT NULL")).select(
        "run_id", "case_id", "category", "score", F.array_join("failure_reasons", "|").alias("reasons"))


def deltas(c):
    return P.run_deltas(P.run_summary(compared(c)), runs(c))


@query("e18_run_deltas", """
    SELECT run_id, pass_rate, retrieval_hit_rate, groundedness_rate, refusal_correctness_rate, citation_integrity_rate, average_latency_ms,
      average_score, regression_count FROM run_delta""", VIEWS)
def _(c):
    return deltas(c).select("run_id", *[F.col(f"{n}_delta").alias(n) for n in P.DELTAS]).withColumn(
        "regression_count", F.col("regression_count").cast("long"))


@query("e19_meaningful_changes", """
    SELECT run_id, metric, delta, threshold, CASE WHEN (metric = 'average_latency_ms') = (delta < 0) THEN 'improved' ELSE 'regressed' END AS direction
    FROM (SELECT run_id, unnest(['pass_rate', 'retrieval_hit_rate', 'groundedness_rate', 'refusal_correctness_rate', 'citation_integrity_rate',
              'average_score', 'average_latency_ms']) AS metric,
            unnest([pass_rate, retrieval_hit_rate, groundedness_rate, refusal_correctness_rate, citation_integrity_rate, average_score, average_latency_ms]) AS delta,
            unnest(list_concat(list_transform(generate_series(1, 6), lambda i: round(greatest(0.05::DOUBLE, 1 / cases::DOUBLE), 4)),
              [round(greatest(250.0::DOUBLE, prev_latency * 0.2::DOUBLE), 4)])) AS threshold FROM run_delta)
    WHERE abs(delta) >= threshold""", VIEWS)
def _(c):
    return P.meaningful_changes(deltas(c))


@query("e20_notable_regressions", """
    SELECT run_id, case_id, score_delta, position FROM (SELECT run_id, case_id, round(score - p_score, 4) AS score_delta,
      row_number() OVER (PARTITION BY run_id ORDER BY p_passed DESC, round(score - p_score, 4), case_id) AS position FROM eval_flag WHERE flag)
    WHERE position <= 10""", VIEWS)
def _(c):
    return P.notable_regressions(compared(c)).select("run_id", "case_id", "score_delta", F.col("position").cast("long"))


@query("e21_reconstruct_summary", """
    SELECT run_id, total_cases, CASE WHEN run_id = 'run-2' THEN 0.5 ELSE pass_rate END AS pass_rate,
      CASE WHEN run_id = 'run-2' THEN 0.25 ELSE retrieval_hit_rate END AS retrieval_hit_rate, run_id <> 'run-2' AS reconstructed FROM (
      SELECT run_id, count(*) AS total_cases, round(count(*) FILTER (passed) / count(*)::DOUBLE, 4) AS pass_rate,
        round(count(*) FILTER (hit_score >= 1 AND (case_id % 2 = 0 OR NOT refuses)) / count(*) FILTER (case_id % 2 = 0 OR NOT refuses)::DOUBLE, 4) AS retrieval_hit_rate
      FROM eval_item GROUP BY run_id)""", VIEWS)
def _(c):
    kept = F.lit('{"passRate":0.5,"retrievalHitRate":0.25,"groundednessRate":1,"refusalCorrectnessRate":1,"citationIntegrityRate":1}')
    headers = runs(c).select("run_id", F.when(F.col("run_id") == "run-2", kept).alias("summary"))
    rows = stored_json(c).withColumn("source_hit", F.col("source_hit"))
    return P.reconstruct_summaries(rows, headers).select("run_id", "total_cases", "pass_rate", "retrieval_hit_rate", "reconstructed")


def cases(c):
    q = F.col("query_id")
    return c.questions.select(
        "*", F.get(T.strings(_CATEGORIES), (q % 8).cast("int")).alias("category"), F.lit(None).cast("string").alias("expected_answer"),
        F.lit(None).cast("bigint").alias("expected_document_id"),
        F.when(q % 2 == 0, F.substring("question", 1, 60)).alias("expected_hint"))


@query("e22_run_eval")
def _(c):
    """Two runs of one set, the later one with fewer grounding chunks and slower: the later run's items, compared with the earlier."""
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    asked = cases(c)
    key = F.col("case_id")

    def spent(run):
        return asked.select(F.col("query_id").alias("case_id")).select(
            "case_id", (100 * run + key % 7).cast("int").alias("latency_ms"), (key % 5).cast("int").alias("input_tokens"), (key % 3).cast("int").alias("output_tokens"),
            (key % 5 + key % 3).cast("int").alias("total_tokens"), F.when(key % 19 == 18, F.lit("timeout")).alias("error"))

    first = settle(evaluate.run_eval(asked, c.question_vectors, c.index, as_of, "run-1", usage=spent(1)), "first-run")
    second = evaluate.run_eval(asked, c.question_vectors, c.index, as_of, "run-2", grounding_limit=1, usage=spent(2))
    headers = c.spark.createDataFrame([("run-1", "set", 1, "COMPLETED"), ("run-2", "set", 2, "COMPLETED")], "run_id string, eval_set_id string, started_us long, status string")
    return evaluate.finish_run(second, headers, first).items.select(
        "case_id", "category", "status", "score", "passed", F.array_join("failure_reasons", "|").alias("reasons"), "latency_ms", "regression_flag")


@query("e23_evidence_snippet", f"SELECT doc_id, left({Q.collapse('text')}, 280) AS snippet FROM documents")
def _(c):
    return c.table("documents").select("doc_id", T.evidence_snippet(F.col("text")).alias("snippet"))


@query("g12_dimension_rates", """
    SELECT run_id, 'answer_groundedness' AS dimension, count(grounded) AS applicable_cases, count(*) FILTER (grounded >= 2) AS passed_cases,
      coalesce(round(count(*) FILTER (grounded >= 2) / nullif(count(grounded), 0)::DOUBLE, 4), 0) AS rate FROM eval_item GROUP BY run_id
    UNION ALL SELECT run_id, 'refusal_quality', count(refusal), count(*) FILTER (refusal >= 2),
      coalesce(round(count(*) FILTER (refusal >= 2) / nullif(count(refusal), 0)::DOUBLE, 4), 0) FROM eval_item GROUP BY run_id""", VIEWS)
def _(c):
    return P.dimension_rates(scored(c)).filter("dimension IN ('answer_groundedness', 'refusal_quality')")


@query("g13_run_summary", """
    SELECT run_id, total_cases, passed_cases, pass_rate, retrieval_hit_rate, groundedness_rate, average_latency_ms, average_score,
      regression_count, total_tokens FROM run_sum""", VIEWS)
def _(c):
    return P.run_summary(compared(c)).select(
        "run_id", "total_cases", "passed_cases", "pass_rate", "retrieval_hit_rate", "groundedness_rate", "average_latency_ms",
        "average_score", "regression_count", "total_tokens")


@query("g14_status_breakdown", "SELECT run_id, status, count(*) AS items FROM eval_item GROUP BY run_id, status", VIEWS)
def _(c):
    return P.status_breakdown(scored(c)).select("run_id", F.explode("status_counts").alias("status", "items"))


@query("g15_failure_reason_counts", """
    SELECT run_id, reason, count(*) AS items FROM (SELECT run_id, unnest(reasons) AS reason FROM eval_item) GROUP BY run_id, reason""", VIEWS)
def _(c):
    return P.failure_reason_counts(scored(c))


@query("g16_category_breakdown", """
    SELECT run_id, category, count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases,
      round(count(*) FILTER (passed) / count(*)::DOUBLE, 4) AS pass_rate FROM eval_item GROUP BY run_id, category""", VIEWS)
def _(c):
    return P.category_breakdown(scored(c))


@query("j07_item_vs_previous", """
    SELECT run_id, case_id, has_previous, coalesce(p_score, -1) AS previous_score FROM eval_pair""", VIEWS)
def _(c):
    return P.items_with_previous(scored(c), runs(c)).select(
        "run_id", "case_id", F.col("previous_score").isNotNull().alias("has_previous"), F.coalesce("previous_score", F.lit(-1.0)).alias("previous_score"))


@query("j08_previous_run_asof", """
    SELECT event_id AS run_id, coalesce((SELECT arg_max(event_id, ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'
      AND p.ts < e.ts), -1) AS previous_run_id FROM events e""")
def _(c):
    rows = c.table("events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("eval_set_id"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED").alias("status"))
    return P.previous_runs(rows).select("run_id", F.coalesce("previous_run_id", F.lit(-1)).alias("previous_run_id"))
