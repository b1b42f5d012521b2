"""The entity views again, as SQL over the given tables, for the side-by-side check."""

from __future__ import annotations

import re

from groundwell.functions import fixed_values as V


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def search_text(x: str) -> str:
    return f"lower({collapse(x)})"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def raw_terms(x: str) -> str:
    """Terms with repeats."""
    cleaned = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s\-_/.:]', ' ', 'g')"
    edges = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"
    return (
        rf"list_filter(list_transform(string_split_regex({cleaned}, '\s+'), lambda w: regexp_replace(w, {edges}, '', 'g')), "
        f"lambda w: length(w) >= 2 AND NOT list_contains({sql_list(V.STOP_WORDS)}, w))"
    )


def term_set(x: str) -> str:
    """Distinct terms, order not kept."""
    return f"list_distinct({raw_terms(x)})"


def ordered(x: str) -> str:
    """First occurrences of a list, in order. `x` is named once per use, so pass a column."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def significant(x: str) -> str:
    cleaned = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')"
    return (
        rf"list_filter(string_split_regex({cleaned}, '\s+'), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({sql_list(V.SIGNIFICANT_STOP_WORDS)}, w))"
    )


def quoted_query(x: str) -> str:
    kept = collapse(
        rf"regexp_replace(translate({x}, '“”‘’', '\"\"'''''), '[^\p{{L}}\p{{N}}\s\-_/.:\"]', ' ', 'g')"
    ).replace('\\"', '"')
    quotes = f"(length({kept}) - length(replace({kept}, '\"', '')))"
    unquoted = collapse(f"replace({kept}, '\"', ' ')")
    return f"CASE WHEN {quotes} % 2 = 1 THEN {unquoted} ELSE {kept} END"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0::DOUBLE END"


def coverage(haystack: str, tokens: str) -> str:
    return share(f"len(list_filter({tokens}, lambda q: list_contains({haystack}, q)))", f"len({tokens})")


def phrase_coverage(text: str, phrases: str) -> str:
    return share(f"len(list_filter({phrases}, lambda q: contains({text}, q)))", f"len({phrases})")


def jaccard(a: str, b: str) -> str:
    """Both are lists of distinct terms."""
    return f"""CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE
        len(list_filter({a}, lambda q: list_contains({b}, q)))::DOUBLE
        / (len({a}) + len({b}) - len(list_filter({a}, lambda q: list_contains({b}, q)))) END"""


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) END"


CTES: dict[str, str] = {
    "v_kb": """
        SELECT kb_id, CASE WHEN kb_id = 'src19' THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
               'Support & Ops: Team ' || (n % 7) AS name,
               TIMESTAMP '2024-01-01' + to_hours(n * 24) AS created_at,
               TIMESTAMP '2024-01-01' + to_hours((n * 5 % 11) * 24) AS updated_at
        FROM (SELECT DISTINCT source AS kb_id, substr(source, 4)::INT AS n FROM documents)""",
    "v_document": """
        SELECT doc_id, source AS kb_id, lang AS language, substr(string_split(text, chr(10))[1], 1, 80) AS name,
               CASE WHEN doc_id % 17 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status,
               TIMESTAMP '2024-01-01' + to_hours(doc_id) AS indexed_at, text
        FROM documents""",
    "v_version": """
        SELECT doc_id * 10 + v AS version_id, doc_id, kb_id, v AS version_number,
               CASE WHEN v = 1 + doc_id % 3 THEN status ELSE 'INDEXED' END AS status,
               1 + (doc_id * 10 + v) % 4 AS ingest_version,
               CASE WHEN (doc_id * 10 + v) % 3 = 0 THEN 'DISABLED' ELSE 'COMPLETED' END AS vectorization_status,
               doc_id % 9 AS chunk_count, indexed_at + to_hours(v) AS created_at,
               CASE WHEN (doc_id * 10 + v) % 11 <> 0 THEN indexed_at END AS started_at,
               CASE WHEN (doc_id * 10 + v) % 7 <> 0
                    THEN indexed_at + to_seconds(1 + (doc_id * 10 + v) % 97) END AS finished_at,
               sha256(text) AS content_hash
        FROM (SELECT *, unnest(generate_series(1, 1 + doc_id % 3)) AS v FROM v_document)""",
    "v_job": """
        SELECT *, CASE WHEN status NOT IN ('WAITING', 'ACTIVE')
                       THEN created_at + to_seconds(5 + job_id % 50) END AS finished_at
        FROM (SELECT version_id * 10 + n AS job_id, version_id, doc_id, kb_id,
                     CASE WHEN n = 1 THEN CASE WHEN (version_id + n) % 6 < 4 THEN 'COMPLETED' ELSE 'FAILED' END
                          WHEN (version_id + n) % 6 = 0 THEN 'WAITING' WHEN (version_id + n) % 6 = 1 THEN 'ACTIVE'
                          WHEN (version_id + n) % 6 = 2 THEN 'FAILED' WHEN (version_id + n) % 6 = 3 THEN 'DEAD_LETTER'
                          ELSE 'COMPLETED' END AS status,
                     (version_id * 10 + n) % 4 AS attempts, 3 AS max_attempts,
                     created_at + to_minutes(n * 30) AS created_at
              FROM (SELECT *, unnest([1, 2]) AS n FROM v_version))""",
    "v_member": """
        SELECT 'src' || (c_custkey % 20) AS kb_id, c_custkey AS user_id,
               CASE c_custkey % 3 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'EDITOR' ELSE 'VIEWER' END AS role
        FROM customer""",
    "v_user_role": """
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'SUPER_ADMIN'
               WHEN c_custkey % 70 = 0 THEN 'OPERATOR' ELSE 'USER' END AS system_role
        FROM customer""",
    "v_line_chunk": f"""
        SELECT doc_id || ':' || lpad(line_no::VARCHAR, 5, '0') AS chunk_id, doc_id,
               doc_id * 10 + 1 + doc_id % 3 AS version_id, kb_id, line_no AS chunk_no, line AS content,
               {search_text('line')} AS search_text, sha256({search_text('line')}) AS checksum,
               CASE WHEN line_no % 3 <> 0 THEN array_to_string(list_slice(w, 1, 3), ' ') END AS section_title,
               (line_no - 1) // 5 + 1 AS page_number, name AS source_title, name AS document_title, language,
               CASE WHEN doc_id % 2 = 0 THEN list_slice(w, 1, 2) END AS tags, indexed_at, status AS document_status
        FROM (SELECT *, string_split({collapse('line')}, ' ') AS w
              FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
                           unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM v_document)
              WHERE {collapse('line')} <> '')""",
    "v_live_chunk": """
        SELECT * FROM v_line_chunk WHERE document_status = 'INDEXED'
           AND kb_id IN (SELECT kb_id FROM v_kb WHERE status = 'ACTIVE')""",
    "v_chunk_vector": """
        SELECT c.*, e.embedding, 'mini-embed' AS embedding_model, len(e.embedding) AS embedding_dim
        FROM v_live_chunk c JOIN embeddings e ON e.vec_id = (c.doc_id + c.chunk_no) % (SELECT count(*) FROM embeddings)""",
    "v_question": r"""
        SELECT query_id, kb_id, user_id, CASE WHEN query_id % 9 = 4 THEN q || '?' ELSE q END AS question,
               document_ids, languages
        FROM (SELECT item_id AS query_id, 'src' || (item_id % 20) AS kb_id, 1 + item_id % 60 AS user_id,
                     CASE WHEN item_id % 5 = 0 THEN 'latest ' || body ELSE body END AS q,
                     CASE WHEN item_id % 6 = 1 THEN coalesce((SELECT list(doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM documents d WHERE d.source = 'src' || (item_id % 20) ORDER BY doc_id LIMIT 20)), []) ELSE [] END AS document_ids,
                     CASE WHEN item_id % 4 = 0 THEN ['en', 'fr'] ELSE [] END AS languages
              FROM (SELECT *, CASE WHEN item_id % 2 = 1
                           THEN '"' || array_to_string(list_slice(w, 1, 2), ' ') || '" '
                                || array_to_string(list_slice(w, 3, 5002), ' ')
                           ELSE text END AS body
                    FROM (SELECT *, string_split_regex(text, '\s+') AS w FROM benchmark)))""",
    "v_question_vector": """
        SELECT q.query_id, q.kb_id, q.document_ids, q.languages, e.embedding, 'mini-embed' AS embedding_model,
               len(e.embedding) AS embedding_dim
        FROM v_question q JOIN embeddings e ON e.vec_id = q.query_id WHERE q.query_id % 7 <> 3""",
    "v_message": """
        SELECT conv_id * 100 + turn AS message_id, conv_id AS conversation_id, upper(role) AS role, text AS content,
               TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at, turn
        FROM conversations""",
    "v_conversation": """
        SELECT DISTINCT conv_id AS conversation_id, 'src' || (conv_id % 20) AS kb_id, 1 + conv_id % 60 AS user_id
        FROM conversations""",
    "v_job_event": """
        SELECT user_id AS job_id, event_id, ts,
               CASE WHEN event_type IN ('signup', 'view') THEN 'start' WHEN event_type = 'click' THEN 'success'
                    WHEN event_type = 'error' THEN 'retryable_failure' ELSE 'terminal_failure' END AS event
        FROM events""",
    "v_metric": """
        SELECT event_id, event_type AS name, json_extract_string(props, '$.k') AS k, value, ts FROM events""",
    # question preparation
    "q_norm": f"""
        SELECT *, lower({quoted_query('question')}) AS normalized_text FROM v_question""",
    "q_raw": f"""
        SELECT *, {raw_terms("normalized_text")} AS raw_tokens,
               list_filter(list_transform(regexp_extract_all(normalized_text, '"([^"]+)"', 1),
                   lambda p: {collapse('p')}), lambda p: length(p) >= 2) AS raw_phrases
        FROM q_norm""",
    "q_terms": f"""
        SELECT *, {ordered('raw_tokens')} AS tokens, {ordered('raw_phrases')} AS phrases FROM q_raw""",
    "q_prepared": f"""
        SELECT *, list_concat(list_transform(phrases, lambda p: '"' || p || '"'),
                   list_filter(tokens, lambda t: NOT list_contains(phrase_tokens, t))) AS lexical_parts,
               len(list_filter(tokens, lambda t: list_contains({sql_list(V.FRESHNESS_WORDS)}, t))) > 0
                 OR len(list_filter(phrases, lambda p: p IN ('last updated', 'most recent'))) > 0 AS freshness_intent,
               contains(question, '?') OR coalesce(list_contains({sql_list(V.QUESTION_WORDS)}, tokens[1]), false)
                 AS question_like
        FROM (SELECT *, flatten(list_transform(phrases, lambda p: {raw_terms('p')})) AS phrase_tokens FROM q_terms)""",
    "q_clauses": f"""
        SELECT *, list_distinct(list_filter(flatten(list_transform(
                     list_filter(tokens, lambda t: NOT list_contains(phrase_tokens, t)),
                     lambda t: {words('t')})), lambda w: length(w) >= 2)) AS word_clauses,
               list_filter(list_transform(phrases, lambda p: list_filter(flatten(list_transform(
                     {raw_terms('p')}, lambda t: {words('t')})), lambda w: length(w) >= 2)),
                 lambda c: len(c) > 0) AS phrase_clauses
        FROM q_prepared""",
    "d_words": f"""
        SELECT *, {words("concat_ws(' ', search_text, coalesce(section_title, ''), coalesce(source_title, ''), document_title)")} AS words
        FROM v_live_chunk""",
    "scoped_pairs": """
        SELECT q.query_id, q.word_clauses, q.phrase_clauses, c.chunk_id, c.words, c.indexed_at
        FROM q_clauses q JOIN d_words c ON c.kb_id = q.kb_id
        WHERE (len(q.document_ids) = 0 OR list_contains(q.document_ids, c.doc_id))
          AND (len(q.languages) = 0 OR list_contains(q.languages, lower(coalesce(c.language, ''))))""",
    "lex_match": """
        SELECT * FROM (
          SELECT query_id, chunk_id, indexed_at,
                 len(list_filter(words, lambda w, i:
                     len(list_filter(word_clauses, lambda p: starts_with(w, p))) > 0
                     OR len(list_filter(phrase_clauses, lambda c:
                          len(list_filter(c, lambda p, j: starts_with(coalesce(words[i + j - 1], ''), p))) = len(c))) > 0
                 )) AS matched_positions
          FROM scoped_pairs) WHERE matched_positions > 0""",
    "lex_top": """
        SELECT * FROM (SELECT *, matched_positions * 0.1::DOUBLE AS lexical_raw,
               row_number() OVER (PARTITION BY query_id ORDER BY matched_positions DESC, indexed_at DESC NULLS LAST,
                                  chunk_id) AS lexical_rank FROM lex_match) WHERE lexical_rank <= 24""",
    "sem_pairs": """
        SELECT q.query_id, c.chunk_id, c.indexed_at, round(1 - list_cosine_similarity(
                 list_transform(q.embedding, lambda x: x::DOUBLE),
                 list_transform(c.embedding, lambda x: x::DOUBLE)), 12) AS semantic_distance
        FROM v_question_vector q JOIN v_chunk_vector c
          ON c.kb_id = q.kb_id AND c.embedding_model = q.embedding_model AND c.embedding_dim = q.embedding_dim
        WHERE (len(q.document_ids) = 0 OR list_contains(q.document_ids, c.doc_id))
          AND (len(q.languages) = 0 OR list_contains(q.languages, lower(coalesce(c.language, ''))))""",
    "sem_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_distance,
               indexed_at DESC NULLS LAST, chunk_id) AS semantic_rank FROM sem_pairs) WHERE semantic_rank <= 24""",
    "merged": """
        SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.chunk_id, l.chunk_id) AS chunk_id,
               s.semantic_distance, s.semantic_rank, l.lexical_raw, l.lexical_rank
        FROM sem_top s FULL OUTER JOIN lex_top l ON s.query_id = l.query_id AND s.chunk_id = l.chunk_id""",
    "cand_terms": f"""
        SELECT m.*, q.tokens, q.phrases, q.freshness_intent, q.question_like, q.document_ids, q.languages,
               c.doc_id, c.version_id, c.kb_id, c.chunk_no, c.content, c.search_text, c.checksum, c.section_title,
               c.page_number, c.source_title, c.document_title, c.language, c.indexed_at,
               {term_set('c.search_text')} AS search_terms,
               {search_text("coalesce(c.section_title, '')")} AS section_match,
               {search_text("coalesce(nullif(c.source_title, ''), c.document_title)")} AS title_match,
               coalesce(list_distinct(flatten(list_transform(c.tags, lambda t: {raw_terms('t')}))), []) AS meta_set,
               coalesce(flatten(list_transform(c.tags, lambda t: {raw_terms('t')})), []) AS meta_terms
        FROM merged m JOIN q_prepared q ON q.query_id = m.query_id JOIN v_live_chunk c ON c.chunk_id = m.chunk_id""",
    "cand_parts": f"""
        SELECT *, {clamp('1 - semantic_distance / 2')} AS semantic_score,
               {coverage('search_terms', 'tokens')} AS token_coverage,
               {phrase_coverage('search_text', 'phrases')} AS phrase_coverage,
               CASE WHEN freshness_intent AND indexed_at IS NOT NULL THEN 1 / (1 + greatest(0.0::DOUBLE,
                    (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(indexed_at)) / 86400e6) / 180) ELSE 0.0::DOUBLE END AS recency_score,
               greatest({coverage(term_set('section_match'), 'tokens')}, {phrase_coverage('section_match', 'phrases')}) AS section_coverage,
               greatest({coverage(term_set('title_match'), 'tokens')}, {phrase_coverage('title_match', 'phrases')}) AS title_coverage,
               greatest({coverage('meta_set', 'tokens')}, {phrase_coverage("array_to_string(list_filter(meta_terms, lambda v, i: list_position(meta_terms, v) = i), ' ')", 'phrases')}) AS tag_coverage,
               question_like AND (contains(lower(coalesce(section_title, '') || ' ' || coalesce(source_title, '')), 'faq')
                 OR contains(lower(coalesce(section_title, '') || ' ' || coalesce(source_title, '')), 'frequently asked')
                 OR contains(coalesce(section_title, '') || ' ' || coalesce(source_title, ''), '?')
                 OR starts_with(search_text, 'q:') OR starts_with(search_text, 'question:')) AS faq_match
        FROM cand_terms""",
    "cand_signals": """
        SELECT *,
               (CASE WHEN len(document_ids) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(languages) > 0 THEN 1 ELSE 0 END)
                 + (CASE WHEN len(meta_terms) > 0 AND (len(tokens) > 0 OR len(phrases) > 0) THEN 1 ELSE 0 END) AS parts,
               (CASE WHEN len(document_ids) > 0 AND list_contains(document_ids, doc_id) THEN 1 ELSE 0 END)
                 + (CASE WHEN len(languages) > 0 AND list_contains(languages, lower(language)) THEN 1 ELSE 0 END)
                 + (CASE WHEN len(meta_terms) > 0 AND (len(tokens) > 0 OR len(phrases) > 0) THEN tag_coverage ELSE 0.0::DOUBLE END) AS part_sum,
               list_filter([CASE WHEN len(document_ids) > 0 AND list_contains(document_ids, doc_id) THEN 'document filter matched' END,
                 CASE WHEN len(languages) > 0 AND list_contains(languages, lower(language)) THEN 'language filter matched' END,
                 CASE WHEN len(meta_terms) > 0 AND (len(tokens) > 0 OR len(phrases) > 0) AND tag_coverage > 0 THEN 'metadata tags aligned' END],
                 lambda x: x IS NOT NULL) AS metadata_signals,
               list_filter([CASE WHEN section_coverage > 0 THEN 'section title aligned' END,
                 CASE WHEN title_coverage > 0 THEN 'source title aligned' END,
                 CASE WHEN faq_match THEN 'faq style chunk' END], lambda x: x IS NOT NULL) AS structural_signals,
               CASE WHEN lexical_raw > 0 THEN lexical_raw / (lexical_raw + 1) ELSE 0.0::DOUBLE END AS rank_norm
        FROM cand_parts""",
    "cand_scores": """
        SELECT *, least(1.0::DOUBLE, 0.55::DOUBLE * rank_norm + 0.25::DOUBLE * token_coverage + 0.2::DOUBLE * phrase_coverage) AS lexical_score,
               CASE WHEN parts > 0 THEN round(part_sum / parts, 6) ELSE 0.0::DOUBLE END AS metadata_score,
               round(least(1.0::DOUBLE, 0.55::DOUBLE * section_coverage + 0.3::DOUBLE * title_coverage
                     + 0.15::DOUBLE * (CASE WHEN faq_match THEN 1 ELSE 0 END)), 6) AS structural_score
        FROM cand_signals""",
    "scored": """
        SELECT *, round(0.4::DOUBLE * semantic_score + 0.4::DOUBLE * lexical_score + 0.1::DOUBLE * metadata_score
                     + 0.03::DOUBLE * recency_score + 0.07::DOUBLE * structural_score, 6) AS hybrid_score
        FROM cand_scores""",
    "ranked": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, semantic_score DESC,
                 lexical_score DESC, metadata_score DESC, structural_score DESC, indexed_at DESC NULLS LAST, chunk_id)
                 AS rank_before_dedup FROM scored) WHERE rank_before_dedup <= 24""",
    "dup_fold": f"""
        SELECT query_id, list_reduce(items, lambda s, c: CASE
            WHEN len(list_filter(s.kept, lambda k: k.chunk_id = c.chunk_id OR k.checksum = c.checksum OR (
                   k.version_id = c.version_id AND abs(k.chunk_no - c.chunk_no) <= 1
                   AND NOT (round(c.phrase_coverage, 6) > round(k.phrase_coverage, 6))
                   AND NOT (c.structural_score > k.structural_score + 0.1::DOUBLE AND c.hits > 0)
                   AND {jaccard('k.search_terms', 'c.search_terms')} >= 0.88))) > 0
            THEN {{'kept': s.kept, 'ids': s.ids}}
            ELSE {{'kept': list_append(s.kept, c), 'ids': list_append(s.ids, c.chunk_id)}} END,
            {{'kept': list_filter(items, lambda x: false), 'ids': list_filter([''], lambda x: false)}}).ids AS kept_ids
        FROM (SELECT query_id, list({{'rank': rank_before_dedup, 'chunk_id': chunk_id, 'checksum': checksum,
                'version_id': version_id, 'chunk_no': chunk_no, 'search_terms': search_terms,
                'phrase_coverage': phrase_coverage, 'structural_score': structural_score,
                'hits': len(structural_signals)}} ORDER BY rank_before_dedup) AS items
              FROM ranked GROUP BY query_id)""",
    "retrieved": """
        SELECT r.*, nullif(list_position(f.kept_ids, r.chunk_id), 0) AS rank_after_dedup
        FROM ranked r JOIN dup_fold f USING (query_id)""",
    "indexed_counts": """
        SELECT kb_id, count(*) AS indexed_chunks FROM v_live_chunk GROUP BY kb_id""",
    "summary": """
        SELECT q.query_id, q.kb_id, coalesce(total_candidates, 0) AS total_candidates,
               coalesce(selected_chunks, 0) AS selected_chunks, coalesce(top_score, 0.0::DOUBLE) AS top_score,
               coalesce(semantic_used, false) AS semantic_used, coalesce(lexical_used, false) AS lexical_used
        FROM v_question q LEFT JOIN (
          SELECT query_id, count(*) AS total_candidates, count(*) FILTER (rank_after_dedup <= 6) AS selected_chunks,
                 max(hybrid_score) FILTER (rank_after_dedup = 1) AS top_score,
                 bool_or(semantic_rank IS NOT NULL) AS semantic_used, bool_or(lexical_rank IS NOT NULL) AS lexical_used
          FROM retrieved GROUP BY query_id) r USING (query_id)""",
}


def using(body: str, extra: dict[str, str] | None = None) -> str:
    """`body` preceded by the views it needs, in order of definition."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b[a-z_0-9]+\b", sql)) & known.keys():
            if name not in needed:
                needed.add(name)
                visit(known[name])

    visit(body)
    if not needed:
        return body
    parts = [f"{name} AS MATERIALIZED ({sql})" for name, sql in known.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body
