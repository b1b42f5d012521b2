"""X, J09: windows, snippets, support, citations, extractive answers, prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwell.conformance import sqlviews as Q
from groundwell.conformance.registry import query
from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import citations as X
from groundwell.operators import entities
from groundwell.plans import retrieve
from groundwell.plans.views import AS_OF


def _sq(text: str) -> str:
    return text.replace("'", "''")


def prepared(c):
    return T.preprocess(c.questions)


#: grounding sets that this application has written, by index
_GROUND: dict[str, str] = {}


def ground(c):
    """The grounding set of every question: what retrieval found, duplicates out. Written once for a state of the tables."""
    root = c.index.root
    if root not in _GROUND:
        _GROUND[root] = f"{root}-grounding"
        found = retrieve.grounding(retrieve.retrieve(c.questions, c.question_vectors, c.index, F.lit(AS_OF).cast("timestamp")))
        kept = [name for name in c.index.chunks.columns if name not in ("seq", "segment")]
        found.select("query_id", *kept, "hybrid_score", F.col("rank_after_dedup").alias("grounding_rank")).write.mode("overwrite").parquet(_GROUND[root])
    return c.spark.read.parquet(_GROUND[root])


def answers(c):
    """An answer per question, made from its two best chunks, that also asks for chunks it must not cite."""
    listed = ground(c).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("grounding_rank", "chunk_id", "search_text"))).alias("items"))
    ids = F.transform("items", lambda x: x["chunk_id"])
    said = F.concat_ws(" ", F.substring(F.get("items", F.lit(0))["search_text"], 1, 200),
                       F.substring(F.get("items", F.lit(1))["search_text"], 1, 100))
    rows = listed.select(
        "query_id", said.alias("answer_text"),
        F.concat(F.slice(ids, 1, 5), F.array(F.lit("0:99999"), F.lit(" 0:99999 "), F.lit(""))).alias("used_chunk_ids"))
    return rows.join(prepared(c).select("query_id", F.col("tokens").alias("query_terms"), "phrases"), "query_id")


def prepared_citations(c):
    return X.prepare_citations(answers(c), ground(c))


VIEWS = {
    "ground": """
        SELECT c.*, r.query_id, r.hybrid_score, r.rank_after_dedup AS grounding_rank
        FROM retrieved r JOIN v_live_chunk c ON c.chunk_id = r.chunk_id WHERE r.rank_after_dedup <= 6""",
    "answer": """
        SELECT query_id, concat_ws(' ', left(max(search_text) FILTER (grounding_rank = 1), 200), left(max(search_text) FILTER (grounding_rank = 2), 100)) AS answer_text
        FROM ground GROUP BY query_id""",
    "asked": f"""
        SELECT a.*, list_distinct({Q.raw_terms('answer_text')}) AS answer_terms, q.tokens AS query_terms, q.phrases
        FROM answer a JOIN q_prepared q USING (query_id)""",
    "cand": f"""
        SELECT g.*, a.answer_terms, a.query_terms, a.phrases, {Q.collapse('g.content')} AS body,
               {Q.term_set('g.search_text')} AS chunk_terms
        FROM ground g JOIN asked a USING (query_id) WHERE g.grounding_rank <= 5""",
    "sentence": r"""
        SELECT *, list_filter(list_transform(raw, lambda x, i: {'start': (lead + coalesce(list_sum(list_transform(raw[1:i - 1], lambda y: length(y))), 0)
            + length(x) - length(ltrim(x)))::BIGINT, 'text': trim(x)}), lambda s: s.text <> '') AS sents
        FROM (SELECT *, regexp_extract_all(body, '[^.!?]+[.!?]*') AS raw, length(regexp_extract(body, '^[.!?]*')) AS lead FROM cand)""",
    "windowed": """
        SELECT *, CASE WHEN len(sents) = 0 THEN [{'start': 0::BIGINT, 'text': body}] ELSE list_concat(sents, list_filter(
            list_transform(generate_series(1, len(sents) - 1), lambda i: {'start': sents[i].start, 'text': trim(substr(body, sents[i].start + 1,
              sents[i + 1].start + length(sents[i + 1].text) - sents[i].start))}), lambda w: length(w.text) <= 420)) END AS wins FROM sentence""",
    "win": """
        SELECT query_id, chunk_id, w.start AS start, w.text AS text, answer_terms, query_terms, phrases, body
        FROM (SELECT *, unnest(wins) AS w FROM windowed)""",
    "win_score": f"""
        SELECT *, 0.5::DOUBLE * {Q.coverage('t', 'answer_terms')} + 0.3::DOUBLE * {Q.coverage('t', 'query_terms')}
            + 0.2::DOUBLE * {Q.phrase_coverage('lower(text)', 'phrases')} AS score
        FROM (SELECT *, {Q.term_set('text')} AS t FROM win)""",
    "best": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, start, length(text), text) AS r
          FROM win_score) WHERE r = 1""",
    "span": """
        SELECT *, CASE WHEN score <= 0 THEN 0 WHEN length(text) <= 280 THEN start ELSE greatest(start, start + anchor - 93) END AS a,
          CASE WHEN score <= 0 THEN least(length(body), 280) WHEN length(text) <= 280 THEN start + length(text)
            ELSE least(start + length(text), greatest(start, start + anchor - 93) + 280) END AS b
        FROM (SELECT *, coalesce(list_min(list_filter(list_transform(list_concat(phrases, answer_terms, query_terms),
                lambda q: instr(lower(text), q)), lambda p: p > 0)), 1) - 1 AS anchor FROM best)""",
    "snip": """
        SELECT query_id, chunk_id, CASE WHEN core = '' THEN NULL ELSE CASE WHEN l > 0 THEN '... ' ELSE '' END || core
            || CASE WHEN r < length(body) THEN ' ...' ELSE '' END END AS snippet
        FROM (SELECT *, trim(substr(body, l + 1, r - l)) AS core FROM (
          SELECT query_id, chunk_id, body, a - length(regexp_extract(substr(body, 1, a), '[^ ]*$')) AS l,
                 b + length(regexp_extract(substr(body, b + 1), '^[^ ]*')) AS r FROM span))""",
    "support": f"""
        SELECT c.*, s.snippet, round(least(1.0::DOUBLE, 0.75::DOUBLE * hybrid_score + 0.15::DOUBLE * ac + 0.1::DOUBLE * qc), 6) AS support_score,
          round(ac, 6) AS answer_coverage, round(qc, 6) AS query_coverage
        FROM (SELECT *, {Q.coverage('chunk_terms', 'answer_terms')} AS ac,
                greatest({Q.coverage('chunk_terms', 'query_terms')}, {Q.phrase_coverage('search_text', 'phrases')}) AS qc FROM cand) c
        JOIN snip s USING (query_id, chunk_id)""",
    "ordered_cite": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support_score DESC, hybrid_score DESC, answer_coverage DESC,
            query_coverage DESC, grounding_rank, page_number NULLS LAST, chunk_id) AS order_no
        FROM support WHERE snippet IS NOT NULL AND support_score >= 0.1""",
    "cite_fold": f"""
        SELECT query_id, list_reduce(items, lambda s, c: CASE
            WHEN len(list_filter(s.kept, lambda k: k.doc_id = c.doc_id AND (
                (k.version_id = c.version_id AND abs(k.chunk_no - c.chunk_no) <= 1 AND {Q.jaccard('k.terms', 'c.terms')} >= 0.9)
                OR (k.section = c.section AND (k.page = c.page OR (k.version_id = c.version_id AND abs(k.chunk_no - c.chunk_no) <= 1))
                    AND {Q.jaccard('k.terms', 'c.terms')} >= 0.82)))) > 0 OR len(s.kept) >= 3
            THEN s ELSE {{'kept': list_append(s.kept, c), 'ids': list_append(s.ids, c.chunk_id)}} END,
            {{'kept': list_filter(items, lambda x: false), 'ids': []::VARCHAR[]}}).ids AS ids
        FROM (SELECT query_id, list({{'chunk_id': chunk_id, 'doc_id': doc_id, 'version_id': version_id, 'chunk_no': chunk_no, 'page': page_number,
               'section': lower(coalesce(section_title, '')), 'terms': chunk_terms}} ORDER BY order_no) AS items FROM ordered_cite GROUP BY query_id)""",
    "match_terms": f"""
        SELECT *, list_distinct(list_filter(asked, lambda q: len(list_filter(own, lambda t: q = t OR (length(q) >= 4 AND length(t) >= 4
            AND (starts_with(q, t) OR starts_with(t, q))))) > 0)) AS matched
        FROM (SELECT g.*, {Q.significant('q.question')} AS asked, {Q.significant('g.search_text')} AS own
              FROM ground g JOIN v_question q ON q.query_id = g.query_id)""",
    "choice": """
        SELECT query_id, list_reduce(items, lambda s, x: CASE WHEN len(s.ids) = 0 OR (len(s.ids) < 3
              AND x.score >= greatest(0.08, 0.75::DOUBLE * top) AND len(list_filter(x.matched, lambda t: NOT list_contains(s.covered, t))) > 0)
            THEN {'ids': list_append(s.ids, x.chunk_id), 'covered': list_concat(s.covered, x.matched)} ELSE s END,
            {'ids': []::VARCHAR[], 'covered': []::VARCHAR[]}).ids AS ids
        FROM (SELECT query_id, max(hybrid_score) FILTER (grounding_rank = 1) AS top,
                list({'chunk_id': chunk_id, 'score': hybrid_score, 'matched': matched} ORDER BY grounding_rank) AS items
              FROM match_terms GROUP BY query_id)""",
    "chosen": "SELECT query_id, unnest(ids) AS chunk_id, unnest(generate_series(1, len(ids))) AS choice_no FROM choice",
}
# the answer's own snippets use the question as the answer text
ANSWER_VIEWS = {
    **VIEWS,
    "asked": f"""
        SELECT query_id, list_distinct({Q.raw_terms('question')}) AS answer_terms, tokens AS query_terms, phrases FROM q_prepared""",
    "cand": f"""
        SELECT g.*, a.answer_terms, a.query_terms, a.phrases, {Q.collapse('g.content')} AS body, [''] AS chunk_terms
        FROM ground g JOIN asked a USING (query_id)""",
    "piece_text": rf"""
        SELECT h.query_id, choice_no, h.chunk_id, {Q.collapse(r"regexp_replace(regexp_replace(coalesce(snippet, content), '^\.{3}\s*', ''), '\s*\.{3}$', '')")} AS p
        FROM chosen h JOIN snip s USING (query_id, chunk_id) JOIN ground g USING (query_id, chunk_id)""",
    "composed": """
        SELECT query_id, left(array_to_string(list_filter(ps, lambda v, i: list_position(ps, v) = i), ' '), 1600) AS answer, used
        FROM (SELECT query_id, list(CASE WHEN regexp_matches(p, '[.!?]$') THEN p ELSE p || '.' END ORDER BY choice_no) AS ps,
                array_to_string(list(chunk_id ORDER BY choice_no), '|') AS used FROM piece_text WHERE p <> '' GROUP BY query_id)""",
}


def with_answer_terms(c):
    return X.requested_chunks(
        answers(c).withColumn("answer_terms", T.terms(F.col("answer_text"))), ground(c)).filter("in_grounding")


@query("j09_requested_vs_grounding", """
    SELECT query_id, chunk_id, true AS in_grounding FROM ground WHERE grounding_rank <= 5
    UNION ALL SELECT DISTINCT query_id, '0:99999', false FROM ground""", VIEWS)
def _(c):
    return X.requested_chunks(answers(c), ground(c)).select("query_id", "chunk_id", "in_grounding")


@query("x01_sentence_windows", "SELECT query_id, chunk_id, start, text FROM win", VIEWS)
def _(c):
    rows = X.with_windows(ground(c).filter("grounding_rank <= 5"))
    return rows.select("query_id", "chunk_id", F.inline("windows")).withColumn("start", F.col("start").cast("long"))


@query("x02_best_window", "SELECT query_id, chunk_id, start, text, round(score, 6) AS score FROM best", VIEWS)
def _(c):
    rows = X.with_windows(with_answer_terms(c)).withColumn("best", X.best_window())
    return rows.select("query_id", "chunk_id", F.col("best.start").cast("long").alias("start"), "best.text",
                       F.round(-F.col("best.loss") + 0.0, 6).alias("score"))


@query("x03_snippet", "SELECT query_id, chunk_id, snippet FROM snip", VIEWS)
def _(c):
    return X.with_snippets(with_answer_terms(c)).select("query_id", "chunk_id", "snippet")


@query("x04_support_score", """
    SELECT query_id, chunk_id, support_score, answer_coverage, query_coverage FROM support""", VIEWS)
def _(c):
    return prepared_citations(c).filter("in_grounding").select(
        "query_id", "chunk_id", "support_score", "answer_coverage", "query_coverage")


@query("x05_citation_order", "SELECT query_id, chunk_id, order_no FROM ordered_cite", VIEWS)
def _(c):
    rows = prepared_citations(c).withColumn("accepted", F.col("reason").isNull())
    order = Window.partitionBy("query_id", "accepted").orderBy(*X.citation_order())
    ranked = rows.withColumn("order_no", F.row_number().over(order).cast("long"))
    return ranked.withColumn("order_no", F.when(F.col("accepted"), F.col("order_no"))).groupBy("query_id", "chunk_id").agg(
        F.max("order_no").alias("order_no")).filter("order_no IS NOT NULL")


@query("x06_citation_redundancy", f"""
    SELECT a.query_id, a.chunk_id AS kept, b.chunk_id AS other, a.version_id = b.version_id AND abs(a.chunk_no - b.chunk_no) <= 1
        AND {Q.jaccard('a.chunk_terms', 'b.chunk_terms')} >= 0.9 OR (lower(coalesce(a.section_title, '')) = lower(coalesce(b.section_title, ''))
        AND (a.page_number = b.page_number OR abs(a.chunk_no - b.chunk_no) <= 1) AND {Q.jaccard('a.chunk_terms', 'b.chunk_terms')} >= 0.82) AS redundant
    FROM support a JOIN support b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.grounding_rank < b.grounding_rank""", VIEWS)
def _(c):
    rows = prepared_citations(c).filter("in_grounding").withColumn("order_no", F.lit(1))
    item = F.struct(*X._PICKED, "grounding_rank")
    left = rows.select("query_id", "doc_id", item.alias("a"))
    right = rows.select("query_id", "doc_id", item.alias("b"))
    pairs = left.join(right, ["query_id", "doc_id"]).filter(F.col("a.grounding_rank") < F.col("b.grounding_rank"))
    return pairs.select("query_id", F.col("a.chunk_id").alias("kept"), F.col("b.chunk_id").alias("other"),
                        X.redundancy_reason(F.col("a"), F.col("b")).isNotNull().alias("redundant"))


@query("x07_select_citations", """
    SELECT s.query_id, s.chunk_id, coalesce(list_position(f.ids, s.chunk_id), 0)::BIGINT AS citation_rank
    FROM support s LEFT JOIN cite_fold f USING (query_id)
    UNION ALL SELECT DISTINCT query_id, '0:99999', 0 FROM ground""", VIEWS)
def _(c):
    return X.select_citations(prepared_citations(c)).select(
        "query_id", "chunk_id", F.coalesce(F.col("citation_rank").cast("long"), F.lit(0).cast("long")).alias("citation_rank"))


@query("x08_extractive_choose", "SELECT query_id, chunk_id, choice_no FROM chosen", VIEWS)
def _(c):
    return X.choose_chunks(c.questions, ground(c)).withColumn("choice_no", F.col("choice_no").cast("long"))


@query("x09_compose_answer", f"""
    SELECT q.query_id, CASE WHEN a.answer IS NULL THEN 'insufficient_data' ELSE 'grounded' END AS status,
      coalesce(a.answer, '{V.NO_EVIDENCE_ANSWER}') AS answer, coalesce(a.used, '') AS used
    FROM v_question q LEFT JOIN composed a USING (query_id)""", ANSWER_VIEWS)
def _(c):
    return X.compose_answers(prepared(c), ground(c)).select(
        "query_id", "status", "answer", F.array_join("used_chunk_ids", "|").alias("used"))


_MODEL_CASES = """
    SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'malformed' WHEN 1 THEN 'invalid_fields' WHEN 2 THEN 'blank_answer' WHEN 5 THEN 'invalid_fields' ELSE '' END AS error,
      CASE item_id % 6 WHEN 3 THEN 'grounded' WHEN 4 THEN 'out_of_scope' ELSE '' END AS status,
      CASE WHEN item_id % 6 IN (3, 4) THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS answer,
      CASE WHEN item_id % 6 = 3 THEN 'a|b|c' ELSE '' END AS used
    FROM benchmark""".replace("\\\\", "\\")


@query("x10_parse_model_answer", _MODEL_CASES)
def _(c):
    kind = F.col("item_id") % 6
    ids = F.array(*[F.lit(x) for x in (" a ", "b", "a", "", "c", "d")])
    good = F.to_json(F.struct(
        F.when(kind == 4, "out_of_scope").otherwise("grounded").alias("status"),
        F.when(kind == 2, "   ").otherwise(F.concat(F.lit(" "), "text")).alias("answer"), ids.alias("used_chunk_ids")))
    text = (
        F.when(kind == 0, F.concat(F.lit("{not json "), "text")).when(kind == 1, F.lit('{"status":"maybe","answer":"x","used_chunk_ids":[]}'))
        .when(kind == 5, F.lit('{"status":"grounded","answer":"x","used_chunk_ids":[1,2]}')).otherwise(good)
    )
    rows = c.table("benchmark").select("item_id", X.parse_model_answer(text).alias("m"))
    blank = F.lit("")
    return rows.select(
        "item_id", F.coalesce("m.error", blank).alias("error"), F.coalesce("m.status", blank).alias("status"),
        F.coalesce("m.answer", blank).alias("answer"), F.coalesce(F.array_join("m.used_chunk_ids", "|"), blank).alias("used"))


@query("x11_finalize_answer", f"""
    SELECT q.query_id, CASE WHEN a.query_id IS NOT NULL AND q.query_id % 4 = 0 THEN 'insufficient_data'
        WHEN a.query_id IS NULL THEN 'insufficient_data' ELSE 'grounded' END AS status,
      CASE WHEN a.query_id IS NOT NULL AND q.query_id % 4 = 0 THEN '{V.NO_CITATION_ANSWER}'
        WHEN a.query_id IS NULL THEN '{V.NO_EVIDENCE_ANSWER}' ELSE a.answer END AS answer
    FROM v_question q LEFT JOIN composed a USING (query_id)""", ANSWER_VIEWS)
def _(c):
    counts = c.questions.filter("query_id % 4 <> 0").select("query_id", F.lit(2).cast("long").alias("citations"))
    return X.finalize_answers(X.compose_answers(prepared(c), ground(c)), counts).select("query_id", "status", "answer")


@query("x12_prompt_table", rf"""
    SELECT q.query_id, '{V.PROMPT_SECTIONS[0]}' || chr(10) || '{V.PROMPT_SCHEMA_HINT}' || chr(10) || chr(10) || '{V.PROMPT_SECTIONS[1]}' || chr(10)
      || CASE WHEN coalesce(g.top, 0) >= 0.6 THEN 'high' WHEN coalesce(g.top, 0) >= 0.2 THEN 'medium' ELSE 'low' END || chr(10) || chr(10)
      || '{V.PROMPT_SECTIONS[2]}' || chr(10) || coalesce(h.talk, 'None') || chr(10) || chr(10) || '{_sq(V.PROMPT_SECTIONS[3])}' || chr(10)
      || coalesce(g.context, '') || chr(10) || chr(10) || '{V.PROMPT_SECTIONS[4]}' || chr(10) || q.question AS prompt
    FROM v_question q LEFT JOIN (SELECT query_id, max(hybrid_score) AS top, string_agg('Chunk ' || grounding_rank || chr(10) || 'chunk_id=' || chunk_id
        || chr(10) || 'document_id=' || doc_id || chr(10) || 'document_title=' || document_title || chr(10) || 'page=' || page_number || chr(10)
        || 'section=' || coalesce(section_title, 'n/a') || chr(10) || 'score=' || printf('%.4f', hybrid_score + CASE WHEN (hybrid_score * 32) % 2 = 1 THEN 1e-9 ELSE 0 END) || chr(10) || 'content:' || chr(10) || content,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY grounding_rank) AS context FROM ground GROUP BY query_id) g USING (query_id)
    LEFT JOIN (SELECT conversation_id AS query_id, string_agg(n || '. [' || role || '] ' || content, chr(10) ORDER BY n) AS talk FROM (
        SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC) AS r FROM v_message) WHERE r <= 6 AND role <> 'SYSTEM')
        GROUP BY conversation_id) h USING (query_id)""", VIEWS)
def _(c):
    history = entities.prompt_history(c.messages).select(
        F.col("conversation_id").alias("query_id"), "history_position", "role", "content")
    return X.prompt_table(c.questions, ground(c), history)


@query("x13_retrieval_meta", """
    SELECT q.query_id, '{"lexicalUsed":' || (n > 0) || ',"semanticUsed":false,"totalCandidates":' || n || ',"selectedChunks":[' || items
      || '],"topScore":' || top || '}' AS meta
    FROM v_question q JOIN (SELECT query_id, count(*) AS n, round(max(hybrid_score), 6) AS top,
        string_agg('{"chunkId":"' || chunk_id || '","score":' || round(hybrid_score, 6) || '}', ',' ORDER BY grounding_rank) AS items FROM ground GROUP BY query_id) g USING (query_id)""", VIEWS)
def _(c):
    base = ground(c).groupBy("query_id").agg(
        (F.count("*") > 0).alias("lexical_used"), F.lit(False).alias("semantic_used"),
        F.count("*").alias("total_candidates"), F.max("hybrid_score").alias("top_score"))
    return X.retrieval_meta(base, ground(c))
