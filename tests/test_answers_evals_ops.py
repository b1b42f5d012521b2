import datetime as dt

from pyspark.sql import functions as F

from groundwell.functions import text as T
from groundwell.operators import audits as A
from groundwell.operators import citations as X
from groundwell.operators import evaluation as E
from groundwell.operators import lifecycle as L
from groundwell.operators import metrics as M
from groundwell.operators import reporting as P
from groundwell.operators import scope
from groundwell.sources import files, tables

ITEM = ("run_id string, case_id int, question string, expected_answer string, expected_document_id string, expected_hint string, "
        "category string, status string, answer string, top_score double, latency_ms int, input_tokens int, output_tokens int, "
        "total_tokens int, sources array<struct<chunk_id:string,document_id:string,document_title:string,section:string,snippet:string>>, "
        "citations array<struct<chunk_id:string,document_id:string,document_title:string,section:string,snippet:string>>, error string")
SOURCE = ("c1", "d1", "Reset guide", None, "press the red reset button twice")


def item(case_id, category, status, answer, sources, citations, expected=None, error=None, run="r1"):
    return (run, case_id, "q", expected, None, None, category, status, answer, 0.5, 100, 50, 50, 100, sources, citations, error)


def test_rubric_per_category(spark):
    rows = [
        item(1, "single source", "grounded", "press the red reset button twice", [SOURCE], [SOURCE], "press the red reset button"),
        item(2, "out_of_scope", "out_of_scope", "I could not find relevant support material.", [], []),
        item(3, "general", "grounded", "unrelated words entirely", [SOURCE], [], "press the red reset button"),
        item(4, "refusal", "grounded", "an answer", [SOURCE], [SOURCE]),
        item(5, "general", "grounded", "x", [SOURCE], [SOURCE], error="boom"),
    ]
    got = {r.case_id: r for r in E.score_items(spark.createDataFrame(rows, ITEM)).collect()}
    assert got[1].passed and got[1].score == 1.0 and not got[1].failure_reasons
    assert got[2].passed and got[2].score == 1.0
    assert not got[3].passed and "citation_integrity_failed" in got[3].failure_reasons
    assert not got[4].passed and got[4].failure_reasons == ["incorrect_refusal", "citation_integrity_failed"]
    assert got[5].failure_reasons == ["execution_failed"] and got[5].score == 0 and got[5].requires_human_review


def test_summary_and_regressions(spark):
    good = item(1, "general", "grounded", "press the red reset button twice", [SOURCE], [SOURCE], "press the red reset button")
    bad = item(1, "general", "insufficient_data", "nothing", [], [], "press the red reset button", run="r2")
    runs = spark.createDataFrame([("r1", "s", "COMPLETED", 1), ("r2", "s", "COMPLETED", 2)], "run_id string, eval_set_id string, status string, started_us bigint")
    scored = E.score_items(spark.createDataFrame([good, bad], ITEM))
    flagged = P.regression_flags(P.items_with_previous(scored, runs))
    assert {r.run_id: r.regression_flag for r in flagged.collect()} == {"r1": False, "r2": True}
    delta = P.run_deltas(P.run_summary(flagged), runs).first()
    assert delta.pass_rate_delta == -1 and delta.retrieval_hit_rate_delta == -1 and delta.regression_count_delta == 1


def test_snippet_is_centred_and_whole_words(spark):
    text = "intro word " * 40 + "the needle stands here " + "tail word " * 40
    df = spark.createDataFrame([(text, ["needle"], ["needle"], [])], "content string, answer_terms array<string>, query_terms array<string>, phrases array<string>")
    snippet = X.with_snippets(df).first().snippet
    assert "needle" in snippet and snippet.startswith("... ") and snippet.endswith(" ...") and len(snippet) < 320


def test_citation_outside_grounding_is_rejected(spark):
    ground = spark.createDataFrame(
        [(1, "a", 1, 1, 1, "reset the worker now.", "reset the worker now.", None, 1, 0.8, 1)],
        "query_id int, chunk_id string, doc_id int, version_id int, chunk_no int, content string, search_text string, "
        "section_title string, page_number int, hybrid_score double, grounding_rank int")
    answers = spark.createDataFrame([(1, "reset the worker", ["a", " a ", "zz"], ["reset"], [])],
                                    "query_id int, answer_text string, used_chunk_ids array<string>, query_terms array<string>, phrases array<string>")
    got = {r.chunk_id: (r.citation_rank, r.reason) for r in X.select_citations(X.prepare_citations(answers, ground)).collect()}
    assert got == {"a": (1, None), "zz": (None, "not_in_grounding_set")}


def test_job_machine(spark):
    log = [("ok", 1, "start"), ("ok", 2, "success"), ("ok", 3, "start"), ("dead", 4, "start"), ("dead", 5, "retryable_failure"),
           ("dead", 6, "start"), ("dead", 7, "retryable_failure"), ("dead", 8, "start"), ("dead", 9, "retryable_failure"), ("idle", 10, "success")]
    rows = [(j, n, dt.datetime(2024, 1, 1, 0, n), e) for j, n, e in log]
    df = spark.createDataFrame(rows, "job_id string, event_id int, ts timestamp, event string")
    got = {r.job_id: (r.status, r.attempts) for r in L.job_states(df).collect()}
    assert got == {"ok": ("COMPLETED", 1), "dead": ("DEAD_LETTER", 3), "idle": ("WAITING", 0)}


def test_access(spark):
    kbs = spark.createDataFrame([("a", "ACTIVE"), ("b", "ARCHIVED")], "kb_id string, status string")
    members = spark.createDataFrame([("a", 1, "VIEWER"), ("b", 1, "OWNER")], "kb_id string, user_id int, role string")
    roles = spark.createDataFrame([(9, "SUPER_ADMIN"), (1, "USER")], "user_id int, system_role string")
    asked = spark.createDataFrame([(1, "a", ["OWNER"]), (1, "b", ["OWNER"]), (9, "a", ["OWNER"]), (2, "a", ["VIEWER"])],
                                  "user_id int, kb_id string, allowed_roles array<string>")
    got = {(r.user_id, r.kb_id): r.decision for r in scope.role_decisions(asked, kbs, members, roles).collect()}
    assert got == {(1, "a"): "forbidden", (1, "b"): "not_found", (9, "a"): "allowed", (2, "a"): "not_found"}


def test_histogram_uses_nearest_rank(spark):
    rows = [(n, "t", {"b": "2", "a": "1"}, float(n), dt.datetime(2024, 1, 1, 0, 0, n)) for n in range(1, 21)]
    df = spark.createDataFrame(rows, "event_id int, name string, tags map<string,string>, value double, ts timestamp")
    row = M.duration_histogram(df, 10).first()
    assert (row.metric, row["count"], row.p50, row.p95, row.max) == ("t{a=1,b=2}", 10, 15.0, 20.0, 20.0)


def test_redaction(spark):
    record = F.lit('{"userToken":"x","requestId":"7"}')
    assert spark.range(1).select(A.log_redact(record).alias("m")).first().m == {"user_token": "[REDACTED]", "request_id": "7"}
    payload = F.lit('{"password":"p","a":{"b":{"c":1},"d":"e"}}')
    assert spark.range(1).select(A.audit_sanitize(payload).alias("m")).first().m == \
        '{"a":{"b":"[truncated]","d":"e"},"password":"[redacted]"}'


def test_files_and_codecs(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"), "a.txt"), (bytearray(b"caf\xe9 au lait"), "b.txt"), (bytearray(b"a\x00b"), "c.txt")], "content binary, key string")
    kinds = [r.k for r in df.select(files.detect_type(F.col("content"), F.lit(""), F.col("key")).alias("k")).collect()]
    assert kinds == ["pdf", "txt", "UNSUPPORTED_FILE_TYPE"]
    assert df.select(files.decode_text(F.col("content")).alias("t")).collect()[1].t == "café au lait"
    text = tables.vector_to_text(F.array(F.lit(0.5), F.lit(-1.25)))
    assert spark.range(1).select(text.alias("t")).first().t == "[0.500000000000,-1.250000000000]"


def test_supersede_closes_only_touched_versions(spark):
    table = spark.createDataFrame([("x", 1, None), ("y", 2, None)], "chunk_id string, version_id int, superseded_at timestamp")
    batch = spark.createDataFrame([("z", 1)], "chunk_id string, version_id int")
    after = L.supersede_chunks(table, batch, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.chunk_id for r in L.live_chunks(after).collect()) == ["y", "z"]


def test_model_answers(spark):
    texts = ['{"status":"grounded","answer":" yes ","used_chunk_ids":[" a ","a","b","c","d"]}', "{oops", '{"status":"grounded","answer":"x","used_chunk_ids":[1]}']
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_model_answer(F.col("t")).alias("m")).collect()]
    assert (got[0].answer, got[0].used_chunk_ids) == ("yes", ["a", "b", "c"])
    assert [m.error for m in got] == [None, "malformed", "invalid_fields"]


def test_terms_are_distinct_in_order(spark):
    assert spark.range(1).select(T.terms(F.lit("Queue, queue: the depth-of queue.")).alias("t")).first().t == ["queue", "depth-of"]
