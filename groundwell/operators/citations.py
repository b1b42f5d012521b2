"""Extractive answers, snippets and ranked citations.

Inputs are at most the grounding limit (6) of chunks per question, so the greedy selections are folds over
short arrays, and everything about one chunk is an expression over its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import scoring as S
from groundwell.functions import text as T

STATUSES = ["grounded", "insufficient_data", "out_of_scope"]
MAX_ANSWER_CHUNKS = 3
MIN_FOLLOW_ON_SCORE = 0.08
FOLLOW_ON_RATIO = 0.75
MAX_ANSWER_LENGTH = 1600
MAX_WINDOW_LENGTH = 420


# struct(at, found): sentences placed so far and the offset the next one starts at
_PLACE_SENTENCES = """aggregate(raw,
    named_struct('at', lead, 'found', cast(array() as array<struct<start:int,text:string>>)),
    (s, x) -> named_struct('at', s.at + length(x), 'found', concat(s.found, array(named_struct(
        'start', s.at + length(x) - length(ltrim(x)), 'text', trim(x))))),
    s -> filter(s.found, f -> f.text <> ''))"""


def with_windows(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add `body`, the text with single blanks, and its candidate `windows`, array<struct(start, text)>:
    sentences, then pairs of neighbouring sentences of up to 420 characters. Starts count from 0."""
    staged = rows.withColumn("body", T.collapse(F.col(content))).withColumns({
        "raw": F.regexp_extract_all("body", F.lit(r"[^.!?]+[.!?]*"), 0),
        "lead": F.length(F.regexp_extract("body", r"^[.!?]*", 0)),
    })
    staged = staged.withColumn("sentences", F.expr(_PLACE_SENTENCES)).drop("raw", "lead")
    spots = F.when(F.size("sentences") > 1, F.sequence(F.lit(0), F.size("sentences") - 2)).otherwise(
        F.array().cast("array<int>")
    )

    def pair(i: Column) -> Column:
        first, second = F.get("sentences", i), F.get("sentences", i + 1)
        end = second["start"] + F.length(second["text"])
        return F.struct(
            first["start"].alias("start"),
            F.trim(F.substring(F.col("body"), first["start"] + 1, end - first["start"])).alias("text"),
        )

    pairs = F.filter(F.transform(spots, pair), lambda w: F.length(w["text"]) <= MAX_WINDOW_LENGTH)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("body").alias("text")))
    windows = F.when(F.size("sentences") > 0, F.concat("sentences", pairs)).otherwise(whole)
    return staged.withColumn("windows", windows).drop("sentences")


def window_score(text: Column, answer_terms: Column, query_terms: Column, phrases: Column) -> Column:
    found = T.terms(text)
    return (
        0.5 * S.token_coverage(found, answer_terms) + 0.3 * S.token_coverage(found, query_terms)
        + 0.2 * S.phrase_coverage(T.search_text(text), phrases)
    )


def best_window() -> Column:
    """struct(loss, start, length, text): the best window; ties go to the earliest, shortest, first by text.
    Reads windows, answer_terms, query_terms and phrases of the row."""
    return F.array_min(F.transform("windows", lambda w: F.struct(
        (-window_score(w["text"], F.col("answer_terms"), F.col("query_terms"), F.col("phrases"))).alias("loss"),
        w["start"].alias("start"), F.length(w["text"]).alias("length"), w["text"].alias("text"),
    )))


def _excerpt(start: Column, end: Column) -> Column:
    """Text between two offsets, widened to whole words, with dots where something was left out."""
    body = F.col("body")
    left = start - F.length(F.regexp_extract(F.substring(body, F.lit(1), start), r"[^ ]*$", 0))
    right = end + F.length(F.regexp_extract(F.substring(body, end + 1, F.length(body)), r"^[^ ]*", 0))
    core = F.trim(F.substring(body, left + 1, right - left))
    shown = F.concat(
        F.when(left > 0, "... ").otherwise(""), core, F.when(right < F.length(body), " ...").otherwise("")
    )
    return F.when(core != "", shown)


def with_snippets(rows: DataFrame) -> DataFrame:
    """Add `snippet` to rows of (content, answer_terms, query_terms, phrases); null when there is no text."""
    staged = with_windows(rows).withColumn("best", best_window())
    size = F.length("body")
    lowered = F.lower(F.col("best.text"))
    spots = F.filter(
        F.transform(F.concat("phrases", "answer_terms", "query_terms"), lambda t: F.instr(lowered, t)),
        lambda p: p > 0,
    )
    anchor = F.coalesce(F.array_min(spots), F.lit(1)) - 1
    best_start, best_end = F.col("best.start"), F.col("best.start") + F.col("best.length")
    long_start = F.greatest(best_start, best_start + anchor - V.SNIPPET_LENGTH // 3)
    start = F.when(F.col("best.loss") >= 0, 0).when(F.col("best.length") <= V.SNIPPET_LENGTH, best_start).otherwise(long_start)
    end = (
        F.when(F.col("best.loss") >= 0, F.least(size, F.lit(V.SNIPPET_LENGTH)))
        .when(F.col("best.length") <= V.SNIPPET_LENGTH, best_end)
        .otherwise(F.least(best_end, long_start + V.SNIPPET_LENGTH))
    )
    staged = staged.withColumn("from_at", start).withColumn("to_at", end)
    snippet = F.when(F.col("body") != "", _excerpt(F.col("from_at"), F.col("to_at")))
    return staged.withColumn("snippet", snippet).drop("windows", "best", "from_at", "to_at", "body")


def support_scores(rows: DataFrame) -> DataFrame:
    """Add answer_coverage, query_coverage and support_score from search_text, hybrid_score and the term arrays."""
    staged = rows.withColumn("chunk_terms", T.terms(F.col("search_text")))
    answer = S.token_coverage(F.col("chunk_terms"), F.col("answer_terms"))
    asked = F.greatest(
        S.token_coverage(F.col("chunk_terms"), F.col("query_terms")),
        S.phrase_coverage(F.col("search_text"), F.col("phrases")),
    )
    staged = staged.withColumn("raw_answer", answer).withColumn("raw_query", asked)
    support = S.clamp01(0.75 * F.col("hybrid_score") + 0.15 * F.col("raw_answer") + 0.1 * F.col("raw_query"))
    return staged.select(
        "*", S.round_fixed(support, 6).alias("support_score"), F.round("raw_answer", 6).alias("answer_coverage"),
        F.round("raw_query", 6).alias("query_coverage"),
    ).drop("raw_answer", "raw_query")


def citation_order() -> list[Column]:
    return [
        F.desc("support_score"), F.desc("hybrid_score"), F.desc("answer_coverage"), F.desc("query_coverage"),
        F.asc("grounding_rank"), F.asc_nulls_last("page_number"), F.asc("chunk_id"),
    ]


def redundancy_reason(kept: Column, other: Column) -> Column:
    """Why `other` adds nothing to the citation `kept`, or null."""
    same_doc = kept["doc_id"] == other["doc_id"]
    near = (kept["version_id"] == other["version_id"]) & (F.abs(kept["chunk_no"] - other["chunk_no"]) <= 1)
    same_page = F.coalesce(kept["page_number"] == other["page_number"], F.lit(False))
    same_section = T.search_text(F.coalesce(kept["section_title"], F.lit(""))) == T.search_text(
        F.coalesce(other["section_title"], F.lit(""))
    )
    overlap = S.jaccard(kept["chunk_terms"], other["chunk_terms"])
    return (
        F.when(kept["chunk_id"] == other["chunk_id"], F.concat(F.lit("duplicate_of_"), kept["chunk_id"]))
        .when(~same_doc, None)
        .when(near & (overlap >= 0.9), F.concat(F.lit("near_duplicate_of_"), kept["chunk_id"]))
        .when(
            same_section & (same_page | near) & (overlap >= 0.82),
            F.concat(F.lit("same_section_redundant_with_"), kept["chunk_id"]),
        )
    )


def requested_chunks(answers: DataFrame, grounding: DataFrame) -> DataFrame:
    """Distinct requested chunk ids per answer, left joined to the grounding set."""
    ids = F.array_distinct(F.filter(F.transform("used_chunk_ids", T.strip), lambda x: x != ""))
    asked = answers.withColumn("chunk_id", F.explode(ids)).drop("used_chunk_ids")
    found = grounding.withColumn("in_grounding", F.lit(True))
    return asked.join(found, ["query_id", "chunk_id"], "left").withColumn(
        "in_grounding", F.coalesce("in_grounding", F.lit(False))
    )


def prepare_citations(answers: DataFrame, grounding: DataFrame) -> DataFrame:
    """Requested chunks with snippet and support; `reason` is set for those already rejected.

    `answers`: query_id, answer_text, used_chunk_ids, query_terms, phrases. `grounding`: query_id, chunk_id,
    doc_id, version_id, chunk_no, content, search_text, section_title, page_number, hybrid_score, grounding_rank.
    """
    asked = requested_chunks(answers.withColumn("answer_terms", T.terms(F.col("answer_text"))), grounding)
    scored = support_scores(with_snippets(asked))
    reason = (
        F.when(~F.col("in_grounding"), "not_in_grounding_set")
        .when(F.col("snippet").isNull(), "snippet_unavailable")
        .when(F.col("support_score") < V.MIN_CITATION_SUPPORT, "support_too_weak")
    )
    return scored.withColumn("reason", reason)


_PICKED = ["order_no", "chunk_id", "doc_id", "version_id", "chunk_no", "page_number", "section_title", "chunk_terms"]


def select_citations(prepared: DataFrame, limit: int = V.CITATION_LIMIT) -> DataFrame:
    """Greedy choice in citation order: redundant ones and those over the limit are rejected with a reason;
    the others get `citation_rank`."""
    order = Window.partitionBy("query_id", F.col("reason").isNull()).orderBy(*citation_order())
    rows = prepared.withColumn("order_no", F.when(F.col("reason").isNull(), F.row_number().over(order)))
    item = F.struct(*_PICKED)
    item_type = rows.select(item.alias("x")).schema["x"].dataType.simpleString()
    # no filter on `reason`: pushed below the scoring it would repeat every expression it is made of
    listed = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), item))).alias("items")
    )

    def step(state: Column, candidate: Column) -> Column:
        hit = F.get(
            F.filter(F.transform(state["kept"], lambda k: redundancy_reason(k, candidate)), lambda r: r.isNotNull()),
            F.lit(0),
        )
        reason = F.when(hit.isNotNull(), hit).when(F.size(state["kept"]) >= limit, "citation_limit_exceeded")
        return F.struct(
            F.when(reason.isNull(), F.concat(state["kept"], F.array(candidate))).otherwise(state["kept"]).alias("kept"),
            F.concat(state["reasons"], F.array(F.coalesce(reason, F.lit("")))).alias("reasons"),
        )

    start = F.struct(
        F.array().cast(f"array<{item_type}>").alias("kept"), F.array().cast("array<string>").alias("reasons")
    )
    verdicts = listed.select("query_id", "items", F.aggregate("items", start, step, lambda s: s["reasons"]).alias("why"))
    flat = verdicts.select("query_id", F.inline(F.arrays_zip(
        F.transform("items", lambda x: x["chunk_id"]).alias("chunk_id"), F.col("why").alias("why"))))
    judged = rows.join(flat, ["query_id", "chunk_id"], "left").withColumn(
        "reason", F.coalesce("reason", F.nullif("why", F.lit("")))
    )
    accepted = Window.partitionBy("query_id", F.col("reason").isNull()).orderBy("order_no")
    return judged.withColumn(
        "citation_rank", F.when(F.col("reason").isNull(), F.row_number().over(accepted))
    ).drop("order_no", "why")


def choose_chunks(questions: DataFrame, grounding: DataFrame) -> DataFrame:
    """Up to three chunks per question for an extractive answer, with `choice_no`.

    The first is always taken; each further one must score close to the best and match a question term no
    earlier choice matched.
    """
    asked = questions.select("query_id", T.significant_terms(F.col("question")).alias("asked_terms"))
    rows = grounding.join(asked, "query_id").withColumn("own_terms", T.significant_terms(F.col("search_text")))
    matched = F.array_distinct(F.filter(
        "asked_terms", lambda q: F.exists("own_terms", lambda t: T.terms_match(q, t))
    ))
    rows = rows.withColumn("matched", matched).drop("own_terms", "asked_terms")
    listed = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("grounding_rank", "chunk_id", "hybrid_score", "matched"))).alias("items")
    )
    top = F.col("items")[0]["hybrid_score"]

    def step(state: Column, x: Column) -> Column:
        n = F.size(state["ids"])
        weak = x["hybrid_score"] < F.greatest(F.lit(MIN_FOLLOW_ON_SCORE), top * FOLLOW_ON_RATIO)
        adds = F.exists(x["matched"], lambda t: ~F.array_contains(state["covered"], t))
        take = (n == 0) | ((n < MAX_ANSWER_CHUNKS) & ~weak & adds)
        return F.struct(
            F.when(take, F.concat(state["ids"], F.array(x["chunk_id"]))).otherwise(state["ids"]).alias("ids"),
            F.when(take, F.concat(state["covered"], x["matched"])).otherwise(state["covered"]).alias("covered"),
        )

    empty = F.array().cast("array<string>")
    folded = listed.select("query_id", F.aggregate(
        "items", F.struct(empty.alias("ids"), empty.alias("covered")), step, lambda s: s["ids"]).alias("ids"))
    return folded.select("query_id", F.posexplode("ids").alias("pos", "chunk_id")).select(
        "query_id", "chunk_id", (F.col("pos") + 1).alias("choice_no")
    )


def clean_snippet(text: Column) -> Column:
    return T.collapse(F.regexp_replace(F.regexp_replace(text, r"^\.{3}\s*", ""), r"\s*\.{3}$", ""))


def compose_answers(questions: DataFrame, grounding: DataFrame) -> DataFrame:
    """(query_id, status, answer, used_chunk_ids) for every question, by extraction from its grounding set.
    `questions` is a preprocessed question table."""
    chosen = choose_chunks(questions, grounding).join(
        grounding.select("query_id", "chunk_id", "content"), ["query_id", "chunk_id"]
    )
    terms = questions.select(
        "query_id", T.terms(F.col("question")).alias("answer_terms"), F.col("tokens").alias("query_terms"), "phrases"
    )
    snippets = with_snippets(chosen.join(terms, "query_id")).withColumn(
        "piece", clean_snippet(F.coalesce("snippet", "content"))
    )
    sentence = F.when(F.col("piece").rlike(r"[.!?]$"), F.col("piece")).otherwise(F.concat("piece", F.lit(".")))
    item = F.struct("choice_no", "chunk_id", sentence.alias("piece"))
    listed = snippets.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("piece") != "", item))).alias("items")
    )
    answer = F.substring(
        F.array_join(F.array_distinct(F.transform("items", lambda x: x["piece"])), " "), 1, MAX_ANSWER_LENGTH
    )
    built = listed.select(
        "query_id", answer.alias("answer"), F.transform("items", lambda x: x["chunk_id"]).alias("used_chunk_ids")
    )
    found = F.coalesce(F.size("used_chunk_ids"), F.lit(0)) > 0
    return questions.select("query_id").join(built, "query_id", "left").select(
        "query_id", F.when(found, "grounded").otherwise("insufficient_data").alias("status"),
        F.when(found, F.col("answer")).otherwise(V.NO_EVIDENCE_ANSWER).alias("answer"),
        F.coalesce("used_chunk_ids", F.array().cast("array<string>")).alias("used_chunk_ids"),
    )


def parse_model_answer(answer_json: Column, limit: int = V.CITATION_LIMIT) -> Column:
    """struct(error, status, answer, used_chunk_ids) of a model's JSON text. `error` says malformed,
    invalid_fields or blank_answer; then the other fields are null."""
    parsed = F.try_parse_json(answer_json)
    status = F.try_variant_get(parsed, "$.status", "string")
    answer = F.try_variant_get(parsed, "$.answer", "string")
    ids = F.try_variant_get(parsed, "$.used_chunk_ids", "array<string>")
    answer_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.answer", "variant"))
    ids_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.used_chunk_ids", "variant"))
    valid = (
        F.coalesce(status.isin(STATUSES), F.lit(False)) & F.coalesce(answer_kind == "STRING", F.lit(False))
        & F.coalesce(ids_kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
        & ~F.coalesce(F.exists(ids, lambda x: x.isNull()), F.lit(False))
    )
    error = (
        F.when(parsed.isNull(), "malformed").when(~valid, "invalid_fields")
        .when(T.strip(answer) == "", "blank_answer")
    )
    kept = F.slice(F.array_distinct(F.filter(F.transform(ids, T.strip), lambda x: x != "")), 1, limit)
    none = F.array().cast("array<string>")
    good = error.isNull()
    return F.struct(
        error.alias("error"), F.when(good, status).alias("status"), F.when(good, T.strip(answer)).alias("answer"),
        F.when(good, F.when(status == "grounded", kept).otherwise(none)).alias("used_chunk_ids"),
    )


def finalize_answers(answers: DataFrame, citation_counts: DataFrame) -> DataFrame:
    """A grounded answer that ended without citations becomes insufficient_data."""
    joined = answers.join(citation_counts, "query_id", "left").na.fill({"citations": 0})
    bare = (F.col("status") == "grounded") & (F.col("citations") == 0)
    return joined.withColumn("answer", F.when(bare, V.NO_CITATION_ANSWER).otherwise(F.col("answer"))).withColumn(
        "status", F.when(bare, "insufficient_data").otherwise(F.col("status"))
    )


def _four_digits(score: Column) -> Column:
    """Four decimals of the number as it is stored. Only an odd multiple of 1/32 lies exactly between two of them; it goes up."""
    between = F.abs(score * 32) % 2 == 1
    return F.when(between, F.format_string("%.4f", score)).otherwise(F.replace(F.format_number(score, 4), F.lit(","), F.lit("")))


def prompt_table(questions: DataFrame, grounding: DataFrame, history: DataFrame) -> DataFrame:
    """One prompt per question: schema hint, evidence strength, numbered history, chunk blocks, question.
    `history`: query_id, history_position, role, content (at most the history limit per question)."""
    number, line_break = F.col("grounding_rank").cast("string"), F.lit("\n")
    block = F.concat_ws(
        "\n", F.concat(F.lit("Chunk "), number), F.concat(F.lit("chunk_id="), "chunk_id"),
        F.concat(F.lit("document_id="), F.col("doc_id").cast("string")),
        F.concat(F.lit("document_title="), "document_title"),
        F.concat(F.lit("page="), F.coalesce(F.col("page_number").cast("string"), F.lit("n/a"))),
        F.concat(F.lit("section="), F.coalesce("section_title", F.lit("n/a"))),
        F.concat(F.lit("score="), _four_digits(F.col("hybrid_score"))), F.lit("content:"), "content",
    )

    def joined(rows: Column, sep: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["block"]), sep)

    context = grounding.withColumn("block", block).groupBy("query_id").agg(
        joined(F.struct("grounding_rank", "block"), "\n\n---\n\n").alias("context"),
        F.max_by("hybrid_score", -F.col("grounding_rank")).alias("top_score"),
    )
    said = F.concat(
        F.col("history_position").cast("string"), F.lit(". ["), "role", F.lit("] "), "content"
    ).alias("block")
    talk = history.select("query_id", "history_position", said).groupBy("query_id").agg(
        joined(F.struct("history_position", "block"), "\n").alias("talk")
    )
    parts = [
        F.lit(V.PROMPT_SCHEMA_HINT), S.evidence_strength(F.coalesce("top_score", F.lit(0.0))),
        F.coalesce("talk", F.lit("None")), F.coalesce("context", F.lit("")), F.col("question"),
    ]
    sections = [F.concat(F.lit(title), line_break, body) for title, body in zip(V.PROMPT_SECTIONS, parts)]
    return (
        questions.select("query_id", "question").join(context, "query_id", "left").join(talk, "query_id", "left")
        .select("query_id", F.concat_ws("\n\n", *sections).alias("prompt"))
    )


def retrieval_meta(summary: DataFrame, grounding: DataFrame) -> DataFrame:
    """JSON summary stored with an answer."""
    picked = grounding.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "grounding_rank", F.col("chunk_id").alias("chunkId"), F.round("hybrid_score", 6).alias("score")))).alias("items"))
    chunks = F.transform("items", lambda x: F.struct(x["chunkId"].alias("chunkId"), x["score"].alias("score")))
    none = F.array().cast("array<struct<chunkId:string,score:double>>")
    return summary.join(picked, "query_id", "left").select("query_id", F.to_json(F.struct(
        F.col("lexical_used").alias("lexicalUsed"), F.col("semantic_used").alias("semanticUsed"),
        F.col("total_candidates").alias("totalCandidates"), F.coalesce(chunks, none).alias("selectedChunks"),
        F.round("top_score", 6).alias("topScore"))).alias("meta"))
