"""R, H, J04-J06, D, Z: candidates, scores, merge, suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.conformance.registry import query
from groundwell.conformance.sqlviews import jaccard, term_set
from groundwell.functions import text as T
from groundwell.operators import dedup, hybrid, lexical, semantic
from groundwell.operators.index import prefix_terms
from groundwell.plans import retrieve as P
from groundwell.plans.views import AS_OF, Corpus


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def prepared(c: Corpus):
    return T.preprocess(c.questions)


def matches(c: Corpus):
    return lexical.lexical_matches(lexical.query_clauses(prepared(c)), c.index)


def semantic_top(c: Corpus):
    return semantic.semantic_topk(c.question_vectors, c.index)


def merged(c: Corpus):
    return hybrid.merge_candidates(semantic_top(c), lexical.lexical_topk(matches(c)))


def scored(c: Corpus):
    found = P.candidates(prepared(c), c.question_vectors, c.index)
    return hybrid.score_candidates(found, prepared(c), P.candidate_chunks(found, c.index), as_of())


def retrieved(c: Corpus):
    return P.retrieve(c.questions, c.question_vectors, c.index, as_of())


def summary(c: Corpus):
    return P.retrieval_summary(c.questions, retrieved(c))


def joined(name: str, sep: str = "|"):
    return F.array_join(name, sep).alias(name)


def r6(name: str):
    return F.round(name, 6).alias(name)


@query("r01_semantic_topk", """
    SELECT query_id, chunk_id, round(semantic_distance, 9) AS semantic_distance,
           round(1 - semantic_distance, 9) AS semantic_similarity, semantic_rank FROM sem_top""")
def _(c):
    return semantic_top(c).select(
        "query_id", "chunk_id", F.round("semantic_distance", 9).alias("semantic_distance"),
        F.round("semantic_similarity", 9).alias("semantic_similarity"), F.col("semantic_rank").cast("long"),
    )


@query("r02_lexical_query", """
    SELECT query_id, array_to_string(list_sort(word_clauses), '|') AS word_clauses,
           array_to_string(list_transform(phrase_clauses, lambda p: array_to_string(p, ' ')), '|') AS phrase_clauses
    FROM q_clauses""")
def _(c):
    return lexical.query_clauses(prepared(c)).select(
        "query_id", F.array_join(F.array_sort("word_clauses"), "|").alias("word_clauses"),
        F.array_join(F.transform("phrase_clauses", lambda p: F.array_join(p, " ")), "|").alias("phrase_clauses"),
    )


@query("r03_lexical_document", """
    SELECT chunk_id, unnest(words) AS term, unnest(generate_series(1, len(words))) AS position FROM d_words""")
def _(c):
    stored = c.index.postings.select("term", F.inline(F.arrays_zip("seqs", "positions"))).select("term", F.col("seqs").alias("seq"), F.explode("positions").alias("p"))
    return stored.join(c.index.chunks.select("seq", "chunk_id"), "seq").select("chunk_id", "term", (F.col("p") + 1).cast("long").alias("position"))


@query("r04_lexical_match_rank", """
    SELECT query_id, chunk_id, matched_positions, round(matched_positions * 0.1::DOUBLE, 6) AS lexical_raw
    FROM lex_match""")
def _(c):
    return matches(c).select(
        "query_id", "chunk_id", F.col("matched_positions").cast("long"), r6("lexical_raw")
    )


@query("r05_lexical_topk", """
    SELECT query_id, chunk_id, round(lexical_raw, 6) AS lexical_raw, lexical_rank FROM lex_top""")
def _(c):
    return lexical.lexical_topk(matches(c)).select(
        "query_id", "chunk_id", r6("lexical_raw"), F.col("lexical_rank").cast("long")
    )


@query("r06_candidate_ranks", """
    SELECT query_id, chunk_id, coalesce(semantic_rank, 0) AS semantic_rank, coalesce(lexical_rank, 0) AS lexical_rank,
           array_to_string(list_filter([CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' END,
             CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END], lambda x: x IS NOT NULL), '|') AS retrieved_by
    FROM merged""")
def _(c):
    zero = F.lit(0).cast("long")
    return merged(c).select(
        "query_id", "chunk_id", F.coalesce(F.col("semantic_rank").cast("long"), zero).alias("semantic_rank"),
        F.coalesce(F.col("lexical_rank").cast("long"), zero).alias("lexical_rank"), joined("retrieved_by"),
    )


@query("r07_retrieval_fallback", """
    SELECT query_id, semantic_used, lexical_used,
           query_id IN (SELECT query_id FROM v_question_vector) AS has_vector FROM summary""")
def _(c):
    has = c.question_vectors.select("query_id").distinct().withColumn("has_vector", F.lit(True))
    return summary(c).join(has, "query_id", "left").select(
        "query_id", "semantic_used", "lexical_used", F.coalesce("has_vector", F.lit(False)).alias("has_vector")
    )


@query("r08_empty_query", """
    SELECT q.query_id, lower(t) AS normalized_text, t = '' AS is_empty,
           CASE WHEN t = '' THEN 0 ELSE coalesce(n, 0) END AS total_candidates
    FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '' ELSE normalized_text END AS t FROM q_prepared) q
    LEFT JOIN (SELECT query_id, count(*) AS n FROM lex_top GROUP BY query_id) r USING (query_id)""")
def _(c):
    asked = c.questions.withColumn(
        "question", F.when(F.col("query_id") % 3 == 0, F.lit(" ?! ")).otherwise(F.col("question"))
    )
    blank = T.preprocess(asked)
    found = lexical.lexical_topk(lexical.lexical_matches(lexical.query_clauses(blank), c.index))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return blank.join(counts, "query_id", "left").select(
        "query_id", "normalized_text", (F.col("normalized_text") == "").alias("is_empty"),
        F.coalesce("n", F.lit(0)).alias("total_candidates"),
    )


@query("r09_rank_debug", """
    SELECT query_id, chunk_id, doc_id, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score,
           metadata_score, round(recency_score, 6) AS recency_score, structural_score, hybrid_score,
           rank_before_dedup FROM ranked""")
def _(c):
    return hybrid.rerank(scored(c)).select(
        "query_id", "chunk_id", "doc_id", r6("semantic_score"), r6("lexical_score"), "metadata_score",
        r6("recency_score"), "structural_score", "hybrid_score",
        F.col("rank_before_dedup").cast("long"),
    )


@query("r10_grounding_set", """
    SELECT query_id, chunk_id, rank_after_dedup::BIGINT AS rank_after_dedup, hybrid_score FROM retrieved
    WHERE rank_after_dedup <= 6""")
def _(c):
    return P.grounding(retrieved(c)).select(
        "query_id", "chunk_id", F.col("rank_after_dedup").cast("long"), "hybrid_score"
    )


@query("r11_retrieve", """
    SELECT query_id, chunk_id, rank_before_dedup, coalesce(rank_after_dedup, 0)::BIGINT AS rank_after_dedup,
           hybrid_score FROM retrieved""")
def _(c):
    return retrieved(c).select(
        "query_id", "chunk_id", F.col("rank_before_dedup").cast("long"),
        F.coalesce(F.col("rank_after_dedup").cast("long"), F.lit(0).cast("long")).alias("rank_after_dedup"),
        "hybrid_score",
    )


@query("r12_answer_gate", """
    SELECT s.query_id, coalesce(n.indexed_chunks, 0) AS indexed_chunks, selected_chunks, top_score,
           CASE WHEN coalesce(n.indexed_chunks, 0) = 0 THEN 'insufficient_data'
                WHEN selected_chunks = 0 OR top_score < CASE WHEN NOT semantic_used AND lexical_used THEN 0.02 ELSE 0.1 END
                THEN 'out_of_scope' ELSE 'proceed' END AS gate
    FROM summary s LEFT JOIN indexed_counts n USING (kb_id)""")
def _(c):
    counts = c.live_line_chunks.groupBy("kb_id").agg(F.count("*").alias("indexed_chunks"))
    return P.answer_gate(summary(c), counts).select(
        "query_id", "indexed_chunks", "selected_chunks", "top_score", "gate"
    )


@query("j04_semantic_pairs", """
    SELECT q.kb_id, count(*) AS pairs, ceil(count(DISTINCT c.chunk_id) / 64.0)::BIGINT AS chunk_blocks
    FROM v_question_vector q JOIN v_chunk_vector c USING (kb_id, embedding_model, embedding_dim) GROUP BY q.kb_id""")
def _(c):
    keys = ["kb_id", "embedding_model", "embedding_dim"]
    left = c.question_vectors.groupBy(keys).agg(F.count("*").alias("l"))
    right = semantic.block_counts(c.index.vectors, 64)
    return left.join(right, keys).select("kb_id", (F.col("l") * F.col("n")).alias("pairs"), F.col("parts").cast("long").alias("chunk_blocks"))


@query("j05_lexical_pairs", """
    SELECT DISTINCT p AS prefix, term FROM (SELECT DISTINCT unnest(word_clauses) AS p FROM q_clauses)
    JOIN (SELECT DISTINCT unnest(words) AS term FROM d_words) ON starts_with(term, p)""")
def _(c):
    asked = lexical.query_clauses(prepared(c)).select(F.explode("word_clauses").alias("prefix"))
    return prefix_terms(c.index, asked)


@query("j06_candidate_merge", """
    SELECT query_id, chunk_id, coalesce(round(semantic_distance, 9), -1) AS semantic_distance,
           coalesce(round(lexical_raw, 6), -1) AS lexical_raw, coalesce(semantic_rank, 0) AS semantic_rank,
           coalesce(lexical_rank, 0) AS lexical_rank FROM merged""")
def _(c):
    return merged(c).select(
        "query_id", "chunk_id",
        F.coalesce(F.round("semantic_distance", 9), F.lit(-1.0)).alias("semantic_distance"),
        F.coalesce(F.round("lexical_raw", 6), F.lit(-1.0)).alias("lexical_raw"),
        F.coalesce(F.col("semantic_rank").cast("long"), F.lit(0).cast("long")).alias("semantic_rank"),
        F.coalesce(F.col("lexical_rank").cast("long"), F.lit(0).cast("long")).alias("lexical_rank"),
    )


def _score_query(name: str, column: str, extra: str = ""):
    @query(name, f"SELECT query_id, chunk_id, round({column}, 6) AS {column} {extra} FROM scored")
    def _(c):
        more = ["metadata_signals"] if "metadata_signals" in extra else []
        more += ["structural_signals"] if "structural_signals" in extra else []
        return scored(c).select("query_id", "chunk_id", r6(column), *[joined(m) for m in more])


_score_query("h01_lexical_score", "lexical_score")
_score_query("h02_metadata_score", "metadata_score", ", array_to_string(metadata_signals, '|') AS metadata_signals")
_score_query("h03_structural_score", "structural_score", ", array_to_string(structural_signals, '|') AS structural_signals")


@query("h04_hybrid_score", "SELECT query_id, chunk_id, hybrid_score FROM scored")
def _(c):
    return scored(c).select("query_id", "chunk_id", "hybrid_score")


@query("h05_rerank_topn", """
    SELECT query_id, chunk_id, rank_before_dedup FROM ranked WHERE rank_before_dedup <= 10""")
def _(c):
    return hybrid.rerank(scored(c), 10).select("query_id", "chunk_id", F.col("rank_before_dedup").cast("long"))


@query("h06_selection_reason", """
    SELECT query_id, chunk_id, CASE WHEN len(r) > 0 THEN array_to_string(list_slice(r, 1, 3), '; ')
           ELSE 'scored from available signals' END AS selection_reason
    FROM (SELECT query_id, chunk_id, list_filter([
        CASE WHEN semantic_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'semantic and lexical retrieval agreed' END,
        CASE WHEN semantic_score >= 0.75 THEN 'strong semantic match' WHEN semantic_score >= 0.55 THEN 'good semantic match' END,
        CASE WHEN phrase_coverage > 0 THEN 'exact phrase match' WHEN token_coverage >= 0.6 THEN 'high lexical overlap' END,
        CASE WHEN metadata_score > 0 AND len(metadata_signals) > 0 THEN metadata_signals[1] END,
        CASE WHEN structural_score >= 0.2 AND len(structural_signals) > 0 THEN structural_signals[1] END,
        CASE WHEN freshness_intent AND recency_score >= 0.45 THEN 'fresh content for time-sensitive query' END],
        lambda x: x IS NOT NULL) AS r FROM scored)""")
def _(c):
    return scored(c).select("query_id", "chunk_id", "selection_reason")


@query("d01_exact_dup", """
    SELECT chunk_id, kb_id, row_number() OVER (PARTITION BY kb_id, checksum ORDER BY chunk_id) > 1 AS is_duplicate
    FROM v_live_chunk""")
def _(c):
    return dedup.exact_duplicates(c.live_line_chunks, ["kb_id"], [F.asc("chunk_id")]).select(
        "chunk_id", "kb_id", "is_duplicate"
    )


@query("d02_near_dup_rule", """
    SELECT a.query_id, a.chunk_id AS left_id, b.chunk_id AS right_id,
           a.version_id = b.version_id AND NOT (round(b.phrase_coverage, 6) > round(a.phrase_coverage, 6))
             AND NOT (b.structural_score > a.structural_score + 0.1::DOUBLE AND len(b.structural_signals) > 0)
             AND {jac} >= 0.3 AS near_duplicate
    FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.version_id = b.version_id
         AND a.rank_before_dedup < b.rank_before_dedup AND abs(a.chunk_no - b.chunk_no) <= 1""".replace(
    "{jac}", jaccard(
        "a.search_terms", "b.search_terms")))
def _(c):
    rows = hybrid.rerank(scored(c)).withColumn("structural_hits", F.size("structural_signals"))
    item = F.struct(*dedup._FOLDED)
    # a question's candidates meet their neighbours by the number of the next chunk, never all against all
    left = rows.select("query_id", "version_id", item.alias("a"), F.explode(
        F.array(F.col("chunk_no") - 1, F.col("chunk_no"), F.col("chunk_no") + 1)).alias("chunk_no"))
    right = rows.select("query_id", "version_id", "chunk_no", item.alias("b"))
    pairs = left.join(right, ["query_id", "version_id", "chunk_no"]).filter(
        F.col("a.rank_before_dedup") < F.col("b.rank_before_dedup"))
    return pairs.select(
        "query_id", F.col("a.chunk_id").alias("left_id"), F.col("b.chunk_id").alias("right_id"),
        dedup.is_near_duplicate(F.col("a"), F.col("b"), 0.3).alias("near_duplicate"),
    )


@query("d03_suppress_duplicates", """
    SELECT query_id, chunk_id, coalesce(rank_after_dedup, 0)::BIGINT AS rank_after_dedup,
           rank_after_dedup IS NULL AS suppressed FROM retrieved""")
def _(c):
    return retrieved(c).select(
        "query_id", "chunk_id",
        F.coalesce(F.col("rank_after_dedup").cast("long"), F.lit(0).cast("long")).alias("rank_after_dedup"),
        F.col("dedup_reason").isNotNull().alias("suppressed"),
    )


@query("d04_ordered_distinct", """
    SELECT doc_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i), ' ') AS words
    FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)""")
def _(c):
    return c.table("documents").select(
        "doc_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words")
    )


@query("j13_near_dup_pairs", """
    SELECT version_id, left_id, right_id, round(jaccard, 6) AS jaccard FROM (
      SELECT a.version_id, a.chunk_id AS left_id, b.chunk_id AS right_id, {jac} AS jaccard
      FROM t a JOIN t b ON a.version_id = b.version_id AND b.chunk_no = a.chunk_no + 1) WHERE jaccard >= 0.88""".replace(
    "{jac}", jaccard("a.terms", "b.terms")),
    {"t": "SELECT *, {} AS terms FROM v_live_chunk".format(
        term_set("search_text"))})
def _(c):
    return dedup.near_duplicate_pairs(c.live_line_chunks).select("version_id", "left_id", "right_id", r6("jaccard"))


@query("z01_candidate_union", """
    SELECT query_id, chunk_id, coalesce(round(max(semantic_distance), 9), -1) AS distance,
           coalesce(round(max(lexical_raw), 6), -1) AS lexical_raw FROM (
      SELECT query_id, chunk_id, semantic_distance, NULL::DOUBLE AS lexical_raw FROM sem_top
      UNION ALL SELECT query_id, chunk_id, NULL, lexical_raw FROM lex_top) GROUP BY query_id, chunk_id""")
def _(c):
    rows = semantic_top(c).select("query_id", "chunk_id", "semantic_distance").unionByName(
        lexical.lexical_topk(matches(c)).select("query_id", "chunk_id", "lexical_raw"), allowMissingColumns=True
    )
    return rows.groupBy("query_id", "chunk_id").agg(
        F.coalesce(F.round(F.max("semantic_distance"), 9), F.lit(-1.0)).alias("distance"),
        F.coalesce(F.round(F.max("lexical_raw"), 6), F.lit(-1.0)).alias("lexical_raw"),
    )


@query("z02_signal_union", """
    SELECT query_id, chunk_id, array_to_string(list_concat(metadata_signals, structural_signals), '|') AS signals
    FROM scored""")
def _(c):
    return scored(c).select(
        "query_id", "chunk_id",
        F.array_join(F.array_union("metadata_signals", "structural_signals"), "|").alias("signals"),
    )


@query("z03_token_difference", """
    SELECT query_id, array_to_string(list_filter(tokens, lambda t: NOT list_contains(phrase_tokens, t)), ' ') AS rest
    FROM q_prepared""")
def _(c):
    return prepared(c).select(
        "query_id", F.array_join(F.array_except("tokens", T.phrase_terms(F.col("phrases"))), " ").alias("rest")
    )


@query("z04_token_intersection", """
    SELECT query_id, chunk_id, len(list_filter(tokens, lambda t: list_contains(search_terms, t))) AS shared
    FROM cand_terms""")
def _(c):
    return scored(c).select(
        "query_id", "chunk_id", F.size(F.array_intersect("tokens", "search_terms")).cast("long").alias("shared")
    )
