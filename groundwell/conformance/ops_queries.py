"""G, Q, S, U: metrics, audits, sources, hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.conformance import sqlviews as Q
from groundwell.conformance.registry import query
from groundwell.functions import hooks
from groundwell.functions import text as T
from groundwell.operators import audits as A
from groundwell.operators import blocks as B
from groundwell.operators import metrics as M
from groundwell.sources import files, tables


def long(name):
    return F.col(name).cast("long").alias(name)


# --- G ------------------------------------------------------------------------
@query("g01_indexed_chunk_count", "SELECT kb_id, indexed_chunks FROM indexed_counts")
def _(c):
    return M.indexed_chunk_count(c.live_line_chunks)


@query("g02_job_status_counts", """
    SELECT count(*) FILTER (status IN ('FAILED', 'DEAD_LETTER')) AS failed_jobs, count(*) FILTER (status = 'WAITING') AS waiting_jobs,
      count(*) FILTER (status = 'ACTIVE') AS active_jobs, count(*) FILTER (status = 'COMPLETED') AS completed_jobs FROM v_job""")
def _(c):
    return M.job_status_counts(c.jobs)


@query("g03_avg_ingest_ms", """
    SELECT round(coalesce(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0::DOUBLE), 0), 2) AS average_duration_ms
    FROM v_version""")
def _(c):
    return M.average_ingest_ms(c.versions)


@query("g04_counter_totals", """
    SELECT name || '{k=' || k || '}' AS metric, round(sum(value), 4) AS total FROM v_metric GROUP BY 1""")
def _(c):
    return M.counter_totals(c.metric_samples).select("metric", F.round("total", 4).alias("total"))


@query("g05_metric_key", """
    SELECT event_id, name || CASE WHEN event_id % 4 = 0 THEN '' ELSE '{a=' || CASE WHEN event_id % 4 = 1 THEN 'null' ELSE k END
           || ',k=' || k || '}' END AS metric FROM v_metric""")
def _(c):
    k = F.col("tags")["k"]
    tags = F.when(F.col("event_id") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("k"), k, F.lit("a"), F.when(F.col("event_id") % 4 != 1, k))
    )
    return c.metric_samples.select("event_id", M.metric_key(F.col("name"), tags).alias("metric"))


_HISTOGRAM = """
    SELECT metric, count(*) AS count, round(avg(value), 2) AS avg,
      round(list(value ORDER BY value)[greatest(1, ceil(count(*) * 0.5))::INT], 2) AS p50,
      round(list(value ORDER BY value)[greatest(1, ceil(count(*) * 0.95))::INT], 2) AS p95, round(max(value), 2) AS max
    FROM (SELECT {key} AS metric, value, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) AS r
          FROM {source}) WHERE r <= 500 GROUP BY metric"""


@query("g06_duration_histogram", _HISTOGRAM.format(key="name", source="v_metric"))
def _(c):
    bare = c.metric_samples.withColumn("tags", F.create_map().cast("map<string,string>"))
    return M.duration_histogram(bare)


@query("g07_stage_timings", _HISTOGRAM.format(
    key="'stage_duration_ms{kb_id=src' || (event_id % 5) || ',stage=' || name || '}'", source="v_metric"))
def _(c):
    rows = c.metric_samples.select(
        "event_id", "ts", "value", F.col("name").alias("stage"),
        F.concat(F.lit("src"), (F.col("event_id") % 5).cast("string")).alias("kb_id"),
    )
    return M.stage_timings(rows)


@query("g08_zero_hit_rate", """
    SELECT kb_id, count(*) AS questions, count(*) FILTER (selected_chunks = 0) AS zero_hits,
      round(avg(CASE WHEN selected_chunks = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS zero_hit_rate FROM summary GROUP BY kb_id""")
def _(c):
    from groundwell.conformance.retrieval_queries import summary

    return M.zero_hit_rate(summary(c))


@query("g09_chat_outcomes", """
    SELECT CASE event_type WHEN 'purchase' THEN 'grounded' WHEN 'view' THEN 'out_of_scope' ELSE 'insufficient_data' END AS status,
      'src' || (user_id % 20) AS kb_id, count(*) AS requests, round(sum(value), 2) AS total_ms, round(max(value), 2) AS max_ms
    FROM events GROUP BY 1, 2""")
def _(c):
    status = F.when(F.col("event_type") == "purchase", "grounded").when(F.col("event_type") == "view", "out_of_scope") \
        .otherwise("insufficient_data")
    rows = c.table("events").select(
        status.alias("status"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("kb_id"),
        F.col("value").alias("duration_ms"))
    return M.outcome_stats(rows, "status", "kb_id")


@query("g10_token_usage", """
    SELECT 'model-' || (event_id % 3) AS model, event_type AS request_type, CASE WHEN event_id % 10 = 0 THEN 'failure' ELSE 'success' END AS outcome,
      count(*) AS requests, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS input_tokens,
      sum(json_extract_string(props, '$.k')::BIGINT * 2)::BIGINT AS output_tokens FROM events GROUP BY 1, 2, 3""")
def _(c):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = c.table("events").select(
        F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.col("event_type").alias("request_type"),
        F.when(F.col("event_id") % 10 == 0, "failure").otherwise("success").alias("outcome"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"))
    return M.token_usage(rows)


@query("g11_http_route_stats", r"""
    SELECT regexp_extract(string_split(url, '?')[1], '^(?:[a-z]+://[^/?#]+)?([^#]*)', 1) AS route, count(*) AS requests,
      round(sum(length(html))::DOUBLE, 2) AS total_ms, round(max(length(html))::DOUBLE, 2) AS max_ms FROM pages GROUP BY 1""")
def _(c):
    rows = c.table("pages").select(
        M.route_path(F.col("url")).alias("route"), F.length("html").cast("double").alias("duration_ms"))
    return M.outcome_stats(rows, "route")


@query("g17_ops_snapshot", """
    SELECT (SELECT count(*) FROM v_job WHERE status IN ('FAILED', 'DEAD_LETTER')) AS failed_jobs,
      (SELECT count(*) FROM v_job WHERE status = 'WAITING') AS waiting_jobs,
      (SELECT count(*) FROM v_job WHERE status = 'ACTIVE') AS active_jobs,
      (SELECT count(*) FROM v_job WHERE status = 'COMPLETED') AS completed_jobs,
      (SELECT round(coalesce(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0::DOUBLE), 0), 2) FROM v_version) AS average_duration_ms,
      (SELECT arg_max(event_id, ts) FROM events WHERE event_type = 'purchase') AS latest_run_id""")
def _(c):
    runs = c.table("events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED").alias("status"))
    return M.ops_snapshot(c.jobs, c.versions, runs)


# --- Q ------------------------------------------------------------------------
@query("q01_range_checks", """
    SELECT 'attempts_range' AS rule, count(*) FILTER (attempts + version_id % 2 > max_attempts) AS violations FROM v_job
    UNION ALL SELECT 'attempts_positive', count(*) FILTER (attempts + version_id % 2 - 1 < 0) FROM v_job""")
def _(c):
    jobs = c.jobs.withColumn("attempts", F.col("attempts") + F.col("version_id") % 2)
    return A.rule_counts(jobs, {
        "attempts_range": F.col("attempts") <= F.col("max_attempts"), "attempts_positive": F.col("attempts") - 1 >= 0,
    })


@query("q02_nonblank_checks", """
    SELECT 'content_blank' AS rule, count(*) FILTER (length(trim(CASE WHEN chunk_no % 7 = 0 THEN '  ' ELSE content END)) = 0) AS violations FROM v_line_chunk
    UNION ALL SELECT 'checksum_blank', 0 FROM v_kb WHERE kb_id = 'src0'""")
def _(c):
    rows = c.line_chunks.withColumn("content", F.when(F.col("chunk_no") % 7 == 0, "  ").otherwise(F.col("content")))
    return A.rule_counts(rows, A.nonblank("content", "checksum"))


@query("q03_embedding_consistency", """
    SELECT chunk_id FROM v_chunk_vector WHERE doc_id % 6 IN (1, 2)""")
def _(c):
    third = F.col("doc_id") % 6
    rows = (
        c.chunk_vectors.withColumn("embedding_dim", F.when(third == 1, 32).otherwise(F.col("embedding_dim")))
        .withColumn("embedding", F.when(third.isin(2, 3), None).otherwise(F.col("embedding")))
        .withColumn("embedding_model", F.when(third == 3, None).otherwise(F.col("embedding_model")))
        .withColumn("embedding_dim", F.when(third == 3, None).otherwise(F.col("embedding_dim")))
    )
    return rows.filter(~A.embedding_consistent()).select("chunk_id")


@query("q04_json_object_checks", """
    SELECT event_id FROM events WHERE event_id % 5 IN (1, 2)""")
def _(c):
    kind = F.col("event_id") % 5
    text = F.when(kind == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(kind == 2, F.lit("{broken")) \
        .when(kind == 3, None).otherwise(F.col("props"))
    return c.table("events").select("event_id", text.alias("payload")).filter(~A.json_object(F.col("payload"))).select("event_id")


@query("q05_enum_domain", """
    SELECT event_type, count(*) AS rows FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type""")
def _(c):
    rows = c.table("events").filter(~A.in_domain(F.col("event_type"), ["view", "click"]))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"))


@query("q06_uniqueness", """
    SELECT kb_id, search_text, count(*) AS rows FROM v_line_chunk GROUP BY kb_id, search_text HAVING count(*) > 1""")
def _(c):
    return A.duplicates(c.line_chunks, [F.col("kb_id"), F.lower("search_text").alias("search_text")])


@query("q07_composite_fk", """
    SELECT chunk_id FROM v_line_chunk WHERE chunk_no % 9 = 0 AND doc_id % 3 <> 0""")
def _(c):
    other = F.when((F.col("chunk_no") % 9 == 0) & (F.col("doc_id") % 3 != 0), F.col("version_id") + 100000000)
    rows = c.line_chunks.withColumn("version_id", F.coalesce(other, F.col("version_id")))
    return A.orphans(rows.select("chunk_id", "version_id", "doc_id"), c.versions, ["version_id", "doc_id"]).select("chunk_id")


@query("q08_delete_restrict", """
    SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def _(c):
    asked = c.table("customer").filter("c_custkey % 4 = 0").select("c_custkey")
    return A.delete_restricted(asked, c.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("q09_audit_sanitize", r"""
    SELECT event_id, '{"k":' || k || ',"token":"[redacted]","note":"' || CASE WHEN event_id % 3 = 0
        THEN repeat('x', 197) || '...' ELSE 'short' END || '","inner":{"Password":"[redacted]","deep":"[truncated]","n":' || k || '},"list":['
        || array_to_string(list_transform(generate_series(1, 20), lambda i: i::VARCHAR), ',') || '],"lists":[["[truncated]",'
        || k || ']]}' AS payload
    FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def _(c):
    k = F.get_json_object("props", "$.k").cast("int")
    note = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(260))).otherwise("short")
    inner = F.struct(F.lit("p").alias("Password"), F.struct(k.alias("a")).alias("deep"), k.alias("n"))
    payload = F.to_json(F.struct(
        k.alias("k"), F.lit("t").alias("token"), note.alias("note"), inner.alias("inner"),
        F.sequence(F.lit(1), F.lit(25)).alias("list")))
    hidden = F.concat(F.lit(',"lists":[[{"password":"hunter2"},'), k.cast("string"), F.lit("]]}"))
    payload = F.concat(payload.substr(F.lit(1), F.length(payload) - 1), hidden)
    clean = A.audit_sanitize(F.col("payload"))
    rows = c.table("events").select("event_id", payload.alias("payload")).select("event_id", clean.alias("payload"))
    # the key order of a variant object is alphabetical; put the fields back for the comparison
    def field(name):
        return F.get_json_object("payload", f"$.{name}")
    return rows.select("event_id", F.concat(
        F.lit('{"k":'), field("k"), F.lit(',"token":"'), field("token"), F.lit('","note":"'), field("note"),
        F.lit('","inner":{"Password":"'), field("inner.Password"), F.lit('","deep":"'), field("inner.deep"),
        F.lit('","n":'), field("inner.n"), F.lit('},"list":'), field("list"), F.lit(',"lists":'), field("lists"), F.lit("}")).alias("payload"))


@query("q10_log_redact", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, '[REDACTED]' AS api_key, event_type AS event_name, '[REDACTED]' AS user_token,
      '{"list":[[{"api_key":"[REDACTED]","n":' || json_extract_string(props, '$.k') || '}]],"user":{"id":' || json_extract_string(props, '$.k')
      || ',"password":"[REDACTED]"}}' AS details
    FROM events""")
def _(c):
    number = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(F.struct(
        F.get_json_object("props", "$.k").alias("k"), F.lit("secret-value").alias("api-key"),
        F.col("event_type").alias("eventName"), F.lit("abc").alias("userToken"),
        F.struct(
            F.array(F.array(F.struct(F.lit("hunter2").alias("apiKey"), number.alias("n")))).alias("list"),
            F.struct(number.alias("id"), F.struct(F.lit("hunter2").alias("plain")).alias("password")).alias("user"),
        ).alias("details")))
    rows = c.table("events").select("event_id", A.log_redact(record).alias("r"))
    return rows.select("event_id", *[F.col("r")[n].alias(n) for n in ("k", "api_key", "event_name", "user_token", "details")])


@query("q11_correlation_valid", """
    SELECT page_id, regexp_matches(url, '^[A-Za-z0-9._:-]{1,128}$') AS url_ok,
      regexp_matches('page-' || page_id, '^[A-Za-z0-9._:-]{1,128}$') AS id_ok FROM pages""")
def _(c):
    return c.table("pages").select(
        "page_id", A.correlation_valid(F.col("url")).alias("url_ok"),
        A.correlation_valid(F.concat(F.lit("page-"), F.col("page_id").cast("string"))).alias("id_ok"))


# --- S ------------------------------------------------------------------------
@query("s01_scan_files")
def _(c):
    rows = files.scan_files(c.spark, c.directory, "*.parquet")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("s02_missing_files", """
    SELECT 'doc-' || doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'OBJECT_STORAGE_FAILED' ELSE 'FILE_NOT_FOUND' END AS error_code,
      doc_id % 5 = 0 AS retryable FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(c):
    asked = c.table("documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("key"), (F.col("doc_id") % 5 != 0).alias("store_reachable"))
    stored = c.table("embeddings").select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("key"))
    return files.missing_files(asked, stored)


def binary_files(c):
    """Every document as a file: text, PDF-like, DOCX-like, Latin-1 text, or bytes with NULs."""
    kind = F.col("doc_id") % 5
    text = F.col("text")
    content = (
        F.when(kind == 0, F.concat(F.lit(bytearray(b"%PDF-1.7\n")), text.cast("binary")))
        .when(kind == 1, F.concat(
            F.lit(bytearray(b"PK\x03\x04[Content_Types].xml word/document.xml\x00")), text.cast("binary")))
        .when(kind == 2, F.encode(F.regexp_replace(text, "[^\\x00-\\xFF]", ""), "ISO-8859-1"))
        .when(kind == 3, F.concat(F.lit(bytearray(b"\x00\x01\x02")), text.cast("binary")))
        .otherwise(text.cast("binary"))
    )
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"))
    return c.table("documents").select(
        "doc_id", "source", "text", content.alias("content"),
        F.concat(name, F.when(kind == 0, ".pdf").when(kind == 1, ".docx").otherwise(".txt")).alias("filename"))


#: the same files in SQL: `shown` is what the bytes say as text, `latin` the Latin-1 kind
_FILES = {
    "binary_file": r"""
        SELECT doc_id, source, text, regexp_replace(text, '[^\x00-\xFF]', '', 'g') AS latin,
          CASE doc_id % 5 WHEN 0 THEN '%PDF-1.7' || chr(10) || text
            WHEN 1 THEN 'PK' || chr(3) || chr(4) || '[Content_Types].xml word/document.xml' || chr(0) || text
            WHEN 2 THEN regexp_replace(text, '[^\x00-\xFF]', '', 'g')
            WHEN 3 THEN chr(0) || chr(1) || chr(2) || text ELSE text END AS shown,
          'file' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.txt' END AS name FROM documents""",
    "control_share": r"""
        SELECT doc_id, length(regexp_replace(left(shown, 4096), '[^\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'))
          / greatest(1, least(4096, CASE WHEN doc_id % 5 = 2 THEN length(shown) ELSE strlen(shown) END))::DOUBLE AS share FROM binary_file""",
}


@query("s03_detect_type", r"""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 3 THEN 'UNSUPPORTED_FILE_TYPE'
        WHEN 2 THEN CASE WHEN NOT regexp_matches(left(latin, 2048), '[^\x00-\x7F]')
             OR length(regexp_replace(left(latin, 2048), '[^\t\n\r -~]', '', 'g')) / greatest(1, length(left(latin, 2048)))::DOUBLE > 0.9
             THEN 'txt' ELSE 'UNSUPPORTED_FILE_TYPE' END
        ELSE CASE WHEN TRY(decode(b[1:2048])) IS NOT NULL OR length(regexp_replace(s, '[^\t\n\r -~]', '', 'g')) / 2048.0 > 0.9
             THEN 'txt' ELSE 'UNSUPPORTED_FILE_TYPE' END END AS file_type
    FROM (SELECT doc_id, latin, encode(text) AS b, coalesce(TRY(decode(encode(text)[1:2048])), TRY(decode(encode(text)[1:2047])),
            TRY(decode(encode(text)[1:2046]))) AS s FROM binary_file)""", _FILES)
def _(c):
    return binary_files(c).select("doc_id", files.detect_type(F.col("content"), F.lit("application/octet-stream"), F.col("filename")).alias("file_type"))


@query("s04_upload_triple_check", """
    SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 5 = 3 OR (doc_id % 5 IN (2, 4) AND share >= 0.02) THEN 'unsupported_file_type'
      WHEN doc_id % 3 = 1 THEN 'unsupported_declared_type'
      WHEN doc_id % 3 = 2 AND doc_id % 5 <> 0 THEN 'declared_type_mismatch' ELSE 'ok' END AS verdict FROM documents JOIN control_share USING (doc_id)""", _FILES)
def _(c):
    declared = F.when(F.col("doc_id") % 3 == 1, "image/png").when(F.col("doc_id") % 3 == 2, files.PDF) \
        .otherwise("application/octet-stream")
    return binary_files(c).select("doc_id", files.upload_check(F.col("content"), F.col("filename"), declared).alias("verdict"))


@query("s05_decode_text", "SELECT doc_id, shown AS text FROM binary_file", _FILES)
def _(c):
    marked = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.col("content"))).otherwise(F.col("content"))
    return binary_files(c).select("doc_id", files.decode_text(marked).alias("text"))


@query("s06_content_hash_key", """
    SELECT doc_id, source || '/' || CASE WHEN doc_id % 5 = 2
        THEN sha256(unhex(array_to_string(list_transform(string_split(latin, ''), lambda x: printf('%02x', ord(x))), '')))
        ELSE sha256(encode(shown)) END || '-' || name AS key FROM binary_file""", _FILES)
def _(c):
    return binary_files(c).select("doc_id", files.storage_key(F.col("source"), F.col("content"), F.col("filename")).alias("key"))


@query("s07_scan_tables", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(c):
    return tables.scan_table(c.spark, c.directory, "documents").select("doc_id", "lang", "source", "n_chars")


def job_messages(c):
    doc = F.col("doc_id").cast("string")
    return c.versions.select("version_id", tables.build_job_message(
        ingestJobId=F.concat(F.lit("job-"), F.col("version_id").cast("string")), documentId=doc,
        documentVersionId=F.col("version_id").cast("string"), kbId=F.col("kb_id"), bucket=F.lit("docs"),
        s3Key=F.concat(F.col("kb_id"), F.lit("/"), F.col("content_hash")), mimeType=F.lit(files.TEXT),
        sourceTitle=F.concat(F.lit("doc "), doc), correlationId=F.concat(F.lit("c-"), doc), pipelineVersion=F.lit("v1"),
        ingestVersion=F.col("ingest_version").cast("string")).alias("message"))


@query("s08_parse_job_payload", """
    SELECT version_id, 'job-' || version_id AS job, kb_id, kb_id || '/' || content_hash AS s3_key, ingest_version::BIGINT AS ingest_version FROM v_version""")
def _(c):
    rows = job_messages(c).select("version_id", tables.parse_job_message(F.regexp_replace(
        "message", '"ingestVersion":"(\\d+)"', '"ingestVersion":$1')).alias("m"))
    return rows.select("version_id", F.col("m.ingestJobId").alias("job"), F.col("m.kbId").alias("kb_id"),
                       F.col("m.s3Key").alias("s3_key"), F.col("m.ingestVersion").cast("long").alias("ingest_version"))


@query("s09_build_job_payload", """
    SELECT version_id, '{"ingestJobId":"job-' || version_id || '","documentId":"' || doc_id || '","documentVersionId":"' || version_id
      || '","kbId":"' || kb_id || '","bucket":"docs","s3Key":"' || kb_id || '/' || content_hash || '","mimeType":"text/plain","sourceTitle":"doc '
      || doc_id || '","correlationId":"c-' || doc_id || '","pipelineVersion":"v1","ingestVersion":"' || ingest_version || '"}' AS message FROM v_version""")
def _(c):
    return job_messages(c)


@query("s10_vector_text_codec", """
    SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.12f', x::DOUBLE)), ',') || ']' AS text,
      round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings""")
def _(c):
    rows = c.table("embeddings").select("vec_id", tables.vector_to_text(F.col("embedding")).alias("text"))
    total = F.aggregate(tables.text_to_vector(F.col("text")), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", "text", F.round(total, 5).alias("total"))


@query("s11_write_chunks", """
    SELECT kb_id, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM v_line_chunk GROUP BY kb_id""")
def _(c):
    path = tables.shared_dir(c.spark, "chunks")
    tables.write_chunks(c.line_chunks.select("chunk_id", "doc_id", "kb_id", "chunk_no", "content"), path)
    stored = c.spark.read.parquet(path)
    return stored.groupBy("kb_id").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


@query("s13_upsert_by_key", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seen' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'AUTO' ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 10 <> 9 UNION ALL
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seen' ELSE 'new' END, CASE WHEN c_custkey % 2 = 0 THEN 'AUTO' ELSE 'none' END
    FROM customer WHERE c_custkey % 10 = 9""")
def _(c):
    key = F.col("c_custkey")
    rows = c.table("customer")
    old = rows.filter("c_custkey % 10 <> 9").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    fresh = key % 10 == 9
    new = rows.select(
        "c_custkey", F.when(key % 3 == 0, "seen").when(fresh, "new").alias("name"),
        F.when(key % 2 == 0, "AUTO").when(fresh, "none").alias("segment"))
    return tables.upsert_by_key(old, new, ["c_custkey"])


@query("s14_skip_if_indexed", """
    SELECT d.doc_id FROM v_document d WHERE CASE WHEN d.doc_id % 4 = 0 THEN true
      WHEN d.status = 'INDEXED' THEN false
      ELSE NOT EXISTS (SELECT 1 FROM v_job j WHERE j.doc_id = d.doc_id AND j.status IN ('WAITING', 'ACTIVE')) END""")
def _(c):
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    incoming = c.documents.select("doc_id", F.sha2(changed, 256).alias("content_hash"))
    return tables.skip_if_indexed(incoming, c.documents, c.versions, c.jobs).select("doc_id")


# --- U ------------------------------------------------------------------------
def _letter_counts(texts):
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("u01_embed_fn", """
    SELECT chunk_id, length(content)::DOUBLE AS a, (length(content) - length(replace(content, 'e', '')))::DOUBLE AS b,
      (length(content) - length(replace(content, ' ', '')))::DOUBLE AS c, 3::BIGINT AS dim FROM v_line_chunk""")
def _(c):
    rows = hooks.embed_texts(c.line_chunks.select("chunk_id", "content"), _letter_counts, "letters")
    return rows.select("chunk_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")],
                       F.col("embedding_dim").cast("long").alias("dim"))


def _echo(prompts):
    import json

    return [json.dumps({"status": "grounded", "answer": p.lower()[:20], "used_chunk_ids": []}) for p in prompts]


@query("u02_answer_fn", """
    SELECT item_id, left(lower(text), 20) AS answer, 'grounded' AS status FROM benchmark""")
def _(c):
    rows = hooks.answer_prompts(c.table("benchmark").select("item_id", F.col("text").alias("prompt")), _echo)
    return rows.select("item_id", F.get_json_object("answer_json", "$.answer").alias("answer"),
                       F.get_json_object("answer_json", "$.status").alias("status"))


def _text_lines(content):
    return [(None, line) for line in content.decode("utf-8").split("\n")]


@query("u03_parse_fn", """
    SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def _(c):
    parsed = hooks.parse_files(c.table("documents").select("doc_id", F.col("text").cast("binary").alias("content")), _text_lines)
    return parsed.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))
