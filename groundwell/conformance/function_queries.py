"""F: scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.conformance import sqlviews as Q
from groundwell.conformance.registry import query
from groundwell.functions import fixed_values as V
from groundwell.functions import scoring as S
from groundwell.functions import text as T
from groundwell.plans.views import AS_OF


def prepared(c):
    return T.preprocess(c.questions)


def r6(column, name):
    return F.round(column, 6).alias(name)


@query("f01_normalize_whitespace", f"SELECT doc_id, {Q.collapse('text')} AS text FROM documents")
def _(c):
    return T.normalize_whitespace(c.table("documents").select("doc_id", "text"), "text")


@query("f02_normalize_quoted_query", f"SELECT query_id, {Q.quoted_query('question')} AS normalized FROM v_question")
def _(c):
    return c.questions.select("query_id", T.quoted_query(F.col("question")).alias("normalized"))


@query("f03_quoted_phrases", "SELECT query_id, array_to_string(phrases, '|') AS phrases FROM q_terms")
def _(c):
    return c.questions.select("query_id", F.array_join(T.quoted_phrases(F.col("question")), "|").alias("phrases"))


@query("f04_matching_terms", f"""
    SELECT doc_id, array_to_string({Q.ordered('t')}, '|') AS terms
    FROM (SELECT doc_id, {Q.raw_terms('text')} AS t FROM documents)""")
def _(c):
    return T.with_terms(c.table("documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("terms", "|").alias("terms"))


@query("f05_lexical_text", "SELECT query_id, array_to_string(lexical_parts, ' ') AS lexical_text FROM q_prepared")
def _(c):
    return prepared(c).select("query_id", "lexical_text")


@query("f06_freshness_intent", "SELECT query_id, freshness_intent FROM q_prepared")
def _(c):
    return prepared(c).select("query_id", "freshness_intent")


@query("f07_question_like", "SELECT query_id, question_like FROM q_prepared")
def _(c):
    return prepared(c).select("query_id", "question_like")


@query("f08_preprocess_query", """
    SELECT query_id, normalized_text, array_to_string(tokens, '|') AS tokens, array_to_string(phrases, '|') AS phrases,
           array_to_string(lexical_parts, ' ') AS lexical_text, freshness_intent, question_like FROM q_prepared""")
def _(c):
    return prepared(c).select(
        "query_id", "normalized_text", F.array_join("tokens", "|").alias("tokens"),
        F.array_join("phrases", "|").alias("phrases"), "lexical_text", "freshness_intent", "question_like",
    )


_SIGNED = "CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE WHEN event_id % 51 = 0 THEN 'inf'::DOUBLE ELSE (value - 20) / 40 END"


def _signed():
    event = F.col("event_id")
    return (
        F.when(event % 50 == 0, F.lit(float("nan"))).when(event % 51 == 0, F.lit(float("inf")))
        .otherwise((F.col("value") - 20) / 40)
    )


@query("f09_clamp01", f"SELECT event_id, round({Q.clamp(_SIGNED)}, 6) AS clamped FROM events")
def _(c):
    return c.table("events").select("event_id", r6(S.clamp01(_signed()), "clamped"))


@query("f10_semantic_score", f"SELECT event_id, round({Q.clamp('1 - (' + _SIGNED + ') / 2')}, 6) AS score FROM events")
def _(c):
    return c.table("events").select("event_id", r6(S.semantic_score(_signed()), "score"))


@query("f11_lexical_rank_norm", """
    SELECT event_id, round(CASE WHEN value > 20 THEN (value - 20) / (value - 19) ELSE 0.0::DOUBLE END, 6) AS score
    FROM events""")
def _(c):
    return c.table("events").select("event_id", r6(S.lexical_rank_norm(F.col("value") - 20), "score"))


@query("f12_token_coverage", "SELECT query_id, chunk_id, round(token_coverage, 6) AS coverage FROM cand_parts")
def _(c):
    from groundwell.conformance.retrieval_queries import scored

    return scored(c).select("query_id", "chunk_id", r6("token_coverage", "coverage"))


@query("f13_phrase_coverage", "SELECT query_id, chunk_id, round(phrase_coverage, 6) AS coverage FROM cand_parts")
def _(c):
    from groundwell.conformance.retrieval_queries import scored

    return scored(c).select("query_id", "chunk_id", r6("phrase_coverage", "coverage"))


@query("f14_recency_score", """
    SELECT doc_id, round(CASE WHEN doc_id % 3 <> 0 THEN 1 / (1 + greatest(0.0::DOUBLE,
             (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(indexed_at)) / 86400e6) / 180) ELSE 0.0::DOUBLE END, 6) AS score
    FROM v_document""")
def _(c):
    score = S.recency_score(F.col("indexed_at"), F.col("doc_id") % 3 != 0, F.lit(AS_OF).cast("timestamp"))
    return c.documents.select("doc_id", r6(score, "score"))


@query("f15_jaccard", f"""
    SELECT conversation_id, turn, round({Q.jaccard('a', 'b')}, 6) AS jaccard FROM (
      SELECT x.conversation_id, x.turn, {Q.term_set('x.content')} AS a, {Q.term_set('y.content')} AS b
      FROM v_message x JOIN v_message y ON y.conversation_id = x.conversation_id AND y.turn = x.turn + 1)""")
def _(c):
    left = c.messages.select("conversation_id", "turn", T.terms(F.col("content")).alias("a"))
    right = c.messages.select("conversation_id", (F.col("turn") - 1).alias("turn"), T.terms(F.col("content")).alias("b"))
    return left.join(right, ["conversation_id", "turn"]).select(
        "conversation_id", "turn", r6(S.jaccard(F.col("a"), F.col("b")), "jaccard")
    )


@query("f16_metadata_terms", f"""
    SELECT chunk_id, array_to_string({Q.ordered('t')}, '|') AS terms FROM (
      SELECT chunk_id, coalesce(flatten(list_transform(tags, lambda t: {Q.raw_terms('t')})), []) AS t FROM v_line_chunk)""")
def _(c):
    return c.line_chunks.select("chunk_id", F.array_join(T.metadata_terms(F.col("metadata_json")), "|").alias("terms"))


@query("f17_faq_like", """
    SELECT chunk_id, contains(t, 'faq') OR contains(t, 'frequently asked') OR contains(t, '?')
             OR starts_with(search_text, 'q:') OR starts_with(search_text, 'question:') AS faq_like
    FROM (SELECT *, lower(coalesce(section_title, '') || ' ' || coalesce(source_title, '')) AS t FROM v_line_chunk)""")
def _(c):
    return c.line_chunks.select(
        "chunk_id", S.faq_like(F.col("section_title"), F.col("source_title"), F.col("search_text")).alias("faq_like")
    )


@query("f18_round_fixed", "SELECT event_id, round(value / 7, 4) AS rounded FROM events")
def _(c):
    return c.table("events").select("event_id", S.round_fixed(F.col("value") / 7, 4).alias("rounded"))


@query("f19_significant_terms", f"""
    SELECT doc_id, array_to_string({Q.significant('text')}, '|') AS terms FROM documents""")
def _(c):
    rows = T.with_terms(c.table("documents").select("doc_id", "text"), "text", significant=True)
    return rows.select("doc_id", F.array_join("terms", "|").alias("terms"))


_SIG = {
    "sig": f"""
      SELECT x.conversation_id, x.turn, {Q.significant('x.content')} AS actual, {Q.significant('y.content')} AS expected
      FROM v_message x JOIN v_message y ON y.conversation_id = x.conversation_id AND y.turn = x.turn + 1""",
    "sig_sets": """
      SELECT *, list_distinct(actual) AS a, list_distinct(expected) AS e,
             len(list_filter(list_distinct(actual), lambda w: list_contains(expected, w))) AS overlap FROM sig""",
}


def _sig_pairs(c):
    left = c.messages.select("conversation_id", "turn", T.significant_terms(F.col("content")).alias("actual"))
    right = c.messages.select(
        "conversation_id", (F.col("turn") - 1).alias("turn"), T.significant_terms(F.col("content")).alias("expected")
    )
    return left.join(right, ["conversation_id", "turn"])


@query("f20_term_coverage", f"""
    SELECT conversation_id, turn, round({Q.share("len(list_filter(expected, lambda w: list_contains(actual, w)))", "len(expected)")}, 6)
      AS coverage FROM sig""", _SIG)
def _(c):
    return _sig_pairs(c).select(
        "conversation_id", "turn", r6(S.term_coverage(F.col("actual"), F.col("expected")), "coverage")
    )


@query("f21_lexical_f1", """
    SELECT conversation_id, turn, round(CASE WHEN overlap > 0 THEN 2.0::DOUBLE * overlap / (len(a) + len(e))
             ELSE 0.0::DOUBLE END, 6) AS f1 FROM sig_sets""", _SIG)
def _(c):
    return _sig_pairs(c).select(
        "conversation_id", "turn", r6(S.lexical_f1(F.col("actual"), F.col("expected")), "f1")
    )


@query("f22_terms_match", """
    SELECT conversation_id, turn, coalesce(list_first(actual), '') AS l, coalesce(list_first(expected), '') AS r,
           list_first(actual) = list_first(expected)
             OR (length(list_first(actual)) >= 4 AND length(list_first(expected)) >= 4
                 AND (starts_with(list_first(actual), list_first(expected))
                      OR starts_with(list_first(expected), list_first(actual)))) AS matched
    FROM sig WHERE len(actual) > 0 AND len(expected) > 0""", _SIG)
def _(c):
    pairs = _sig_pairs(c).filter((F.size("actual") > 0) & (F.size("expected") > 0))
    left, right = F.col("actual")[0], F.col("expected")[0]
    return pairs.select(
        "conversation_id", "turn", left.alias("l"), right.alias("r"), T.terms_match(left, right).alias("matched")
    )


@query("f23_slugify", r"""
    SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'),
             '^-+|-+$', '', 'g'), ''), 'knowledge-base') AS slug,
           left(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'),
             '^-+|-+$', '', 'g'), ''), 'knowledge-base'), 48) AS short_slug
    FROM v_document""")
def _(c):
    return c.documents.select(
        "doc_id", T.slugify(F.col("name")).alias("slug"), T.slugify(F.col("name"), 48).alias("short_slug")
    )


@query("f24_safe_filename", r"""
    SELECT doc_id, CASE WHEN NOT regexp_matches(name, '[A-Za-z0-9_]') THEN '' ELSE coalesce(left(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'),
             '-{2,}', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 80) || '.txt', '') END AS filename
    FROM v_document""")
def _(c):
    named = T.with_safe_filename(c.documents.select("doc_id", F.concat("name", F.lit(".txt")).alias("name")), "name")
    return named.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"))


@query("f25_display_name", f"""
    SELECT doc_id, left({Q.collapse("regexp_replace(text, '[' || chr(1) || '-' || chr(31) || ']', ' ', 'g')")}, 200) AS name
    FROM documents""")
def _(c):
    return c.table("documents").select("doc_id", T.display_name(F.col("text")).alias("name"))


@query("f26_short_hash", "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def _(c):
    return c.table("documents").select("doc_id", T.short_hash(F.col("text")).alias("hash"))


@query("f27_conversation_title", f"""
    SELECT message_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title
    FROM (SELECT message_id, {Q.collapse('content')} AS t FROM v_message)""")
def _(c):
    return c.messages.select("message_id", T.conversation_title(F.col("content")).alias("title"))


@query("f28_usage_from_json", """
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT * 2 AS input_tokens,
           json_extract_string(props, '$.k')::BIGINT AS output_tokens,
           CASE WHEN event_id % 3 = 0 THEN 0 ELSE json_extract_string(props, '$.k')::BIGINT * 3 END AS total_tokens,
           CASE WHEN event_id % 2 = 0 THEN 4 ELSE 5 END::BIGINT AS cached_input_tokens, 0::BIGINT AS reasoning_tokens
    FROM events""")
def _(c):
    k = F.get_json_object("props", "$.k").cast("long")
    total = F.when(F.col("event_id") % 3 != 0, k * 3)
    cached = F.when(F.col("event_id") % 2 == 0, 4).otherwise(5).alias("cached_tokens")
    new_style = F.to_json(F.struct(
        (k * 2).alias("input_tokens"), k.alias("output_tokens"), total.alias("total_tokens"),
        F.struct(cached).alias("input_tokens_details"),
    ))
    old_style = F.to_json(F.struct(
        (k * 2).alias("prompt_tokens"), k.alias("completion_tokens"), total.alias("total_tokens"),
        F.struct(cached).alias("prompt_tokens_details"),
    ))
    usage = F.when(F.col("event_id") % 2 == 0, new_style).otherwise(old_style)
    rows = c.table("events").select("event_id", usage.alias("usage"))
    return rows.select("event_id", *[v.alias(n) for n, v in T.usage_counts(F.col("usage")).items()])


_CATEGORY_CASES = ["Single Source", "multi-source", " Out of scope ", "REFUSAL", "recency_sensitive", "unknown", "access sensitive", "ambiguous"]


@query("f29_eval_category", f"""
    SELECT item_id, coalesce((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in V.CATEGORY_ALIASES.items())}}})[
             regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')], 'general') AS category
    FROM (SELECT item_id, {Q.sql_list(_CATEGORY_CASES)}[1 + item_id % 8] AS raw FROM benchmark)""")
def _(c):
    raw = F.get(T.strings(_CATEGORY_CASES), (F.col("item_id") % 8).cast("int"))
    return c.table("benchmark").select("item_id", T.eval_category(raw).alias("category"))


@query("f30_evidence_strength", """
    SELECT event_id, CASE WHEN value / 50 >= 0.6 THEN 'high' WHEN value / 50 >= 0.2 THEN 'medium' ELSE 'low' END AS strength
    FROM events""")
def _(c):
    return c.table("events").select("event_id", S.evidence_strength(F.col("value") / 50).alias("strength"))


@query("f31_backoff_delay", """
    SELECT job_id, least(2000.0::DOUBLE, 250 * power(2.0::DOUBLE, greatest(0, attempts - 1))) AS provider_ms,
           5000 * power(2.0::DOUBLE, greatest(0, attempts - 1)) AS queue_ms FROM v_job""")
def _(c):
    return c.jobs.select(
        "job_id", S.provider_backoff_ms(F.col("attempts"), F.lit(250)).alias("provider_ms"),
        S.queue_backoff_ms(F.col("attempts")).alias("queue_ms"),
    )
