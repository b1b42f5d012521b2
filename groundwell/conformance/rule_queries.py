"""Q01, Q02, Q04-Q07 over the whole model: every rule of the catalogue against tables with planted violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.conformance.registry import query
from groundwell.operators import rules

_FAR = 1_000_000_000


def planted(c):
    """The tables of the model, derived from the given ones, with rows that break each rule."""
    chunks = c.line_chunks.select(
        "chunk_id", "doc_id",
        F.expr("CASE WHEN chunk_no % 8 = 0 THEN 'other' ELSE kb_id END").alias("kb_id"),
        F.expr(f"CASE WHEN chunk_no % 9 = 0 THEN version_id + {_FAR} ELSE version_id END").alias("version_id"),
        F.expr("CASE WHEN chunk_no % 13 = 0 THEN 0 WHEN chunk_no % 14 = 0 THEN chunk_no - 2 ELSE chunk_no END").alias("chunk_no"),
        F.expr("CASE WHEN chunk_no % 7 = 0 THEN 0 ELSE 5 END").alias("token_count"),
        F.expr("CASE WHEN chunk_no % 11 = 0 THEN '  ' ELSE 'section' END").alias("chunking_strategy"),
        F.expr("CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'v2' END").alias("chunking_version"),
        F.expr("CASE WHEN chunk_no % 17 = 0 THEN ' ' ELSE checksum END").alias("checksum"),
        F.expr("CASE chunk_no % 5 WHEN 1 THEN '[1]' WHEN 2 THEN '{bad' WHEN 3 THEN NULL ELSE '{\"a\":1}' END").alias("metadata_json"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE indexed_at END").alias("superseded_at"),
        F.expr("CASE WHEN chunk_no % 3 = 0 THEN NULL ELSE array(1.0D, 2.0D) END").alias("embedding"),
        F.expr("CASE WHEN chunk_no % 3 = 0 AND chunk_no % 6 <> 0 THEN NULL ELSE 'mini' END").alias("embedding_model"),
        F.expr("CASE WHEN chunk_no % 3 = 0 THEN NULL WHEN chunk_no % 10 = 1 THEN 3 ELSE 2 END").alias("embedding_dim"),
    )
    versions = c.versions.select(
        "version_id", F.expr(f"CASE WHEN version_id % 13 = 0 THEN doc_id + {_FAR} ELSE doc_id END").alias("doc_id"),
        F.expr("CASE WHEN version_id % 23 = 0 THEN 0 WHEN version_id % 7 = 0 THEN 1 ELSE version_number END").alias("version_number"),
        F.expr("CASE WHEN version_id % 29 = 0 THEN 0 ELSE ingest_version END").alias("ingest_version"),
        F.expr("CASE WHEN version_id % 31 = 0 THEN -1 ELSE chunk_count END").alias("chunk_count"),
        F.expr("CASE WHEN version_id % 37 = 0 THEN 'LOST' ELSE status END").alias("status"),
        F.expr("CASE WHEN version_id % 41 = 0 THEN 'LOST' ELSE vectorization_status END").alias("vectorization_status"),
    )
    return {
        "knowledge_base": c.kb.select("kb_id", F.expr("CASE WHEN status = 'ARCHIVED' THEN 'GONE' ELSE status END").alias("status"), F.expr(
            "concat(CASE WHEN length(kb_id) % 2 = 0 THEN 'Team-' ELSE 'team-' END, cast(cast(substring(kb_id, 4, 9) AS int) % 7 AS string))").alias("slug")),
        "user": c.user_roles.select("user_id", F.expr("concat(CASE WHEN user_id % 2 = 0 THEN 'U' ELSE 'u' END, cast(user_id % 1001 AS string))").alias("email")),
        "member": c.members.select("kb_id", F.expr("CASE WHEN user_id % 40 >= 20 AND user_id % 3 = 0 THEN user_id - 20 ELSE user_id END").alias("user_id")),
        "document": c.documents.select("doc_id", "kb_id", F.expr("CASE WHEN doc_id % 43 = 0 THEN 'LOST' ELSE status END").alias("status")),
        "version": versions,
        "job": c.jobs.select(
            F.expr(f"CASE WHEN job_id % 61 = 0 THEN version_id + {_FAR} ELSE version_id END").alias("version_id"),
            F.expr("CASE WHEN job_id % 47 = 0 THEN -1 ELSE attempts END").alias("attempts"),
            F.expr("CASE WHEN job_id % 53 = 0 THEN 0 ELSE max_attempts END").alias("max_attempts"),
            F.expr("CASE WHEN job_id % 59 = 0 THEN 'LOST' ELSE status END").alias("status")),
        "chunk": chunks,
        "message": c.messages.select(
            F.expr("CASE turn % 3 WHEN 1 THEN '[]' WHEN 2 THEN NULL ELSE '{}' END").alias("usage_json"),
            F.expr("CASE turn % 4 WHEN 1 THEN '3' WHEN 2 THEN NULL ELSE '{\"x\":[1]}' END").alias("retrieval_meta_json")),
        "citation": c.line_chunks.select(
            F.col("doc_id").alias("message_id"), F.expr("CASE WHEN chunk_no % 6 = 0 THEN concat(doc_id, ':00001') ELSE chunk_id END").alias("chunk_id"),
            F.expr(f"CASE WHEN chunk_no % 4 = 0 THEN doc_id + {_FAR} ELSE doc_id END").alias("doc_id")),
        "eval_set": c.table("benchmark").select(F.expr("item_id % 10").alias("eval_set_id"), F.expr("concat('src', item_id % 10)").alias("kb_id")).distinct(),
        "eval_run": c.table("benchmark").select(
            F.expr("item_id % 10").alias("eval_set_id"), F.expr("CASE WHEN item_id % 7 = 0 THEN 'src99' ELSE concat('src', item_id % 10) END").alias("kb_id"),
            F.expr("CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '{}' END").alias("retrieval_config_json"),
            F.expr("CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '\"s\"' ELSE '{}' END").alias("summary_json")),
        "eval_item": c.table("benchmark").select(
            F.expr("item_id % 3").alias("eval_run_id"), F.expr("item_id div 4").alias("eval_case_id"),
            F.expr("CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '{}' END").alias("retrieved_sources_json"),
            F.expr("CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'true' ELSE '{}' END").alias("usage_json")),
    }


VIEWS = {
    "p_chunk": f"""
        SELECT chunk_id, doc_id, chunk_no AS line, CASE WHEN chunk_no % 8 = 0 THEN 'other' ELSE kb_id END AS kb_id,
          CASE WHEN chunk_no % 9 = 0 THEN version_id + {_FAR} ELSE version_id END AS version_id,
          CASE WHEN chunk_no % 13 = 0 THEN 0 WHEN chunk_no % 14 = 0 THEN chunk_no - 2 ELSE chunk_no END AS chunk_no FROM v_line_chunk""",
    "p_version": f"""
        SELECT version_id, CASE WHEN version_id % 13 = 0 THEN doc_id + {_FAR} ELSE doc_id END AS doc_id,
          CASE WHEN version_id % 23 = 0 THEN 0 WHEN version_id % 7 = 0 THEN 1 ELSE version_number END AS version_number FROM v_version""",
    "p_job": """
        SELECT job_id, CASE WHEN job_id % 61 = 0 THEN NULL ELSE version_id END AS version_id, CASE WHEN job_id % 47 = 0 THEN -1 ELSE attempts END AS attempts,
          CASE WHEN job_id % 53 = 0 THEN 0 ELSE max_attempts END AS max_attempts FROM v_job""",
    "p_citation": """
        SELECT doc_id AS message_id, CASE WHEN chunk_no % 6 = 0 THEN doc_id || ':00001' ELSE chunk_id END AS chunk_id, chunk_no % 4 = 0 AS moved, doc_id FROM v_line_chunk""",
    "broken": """
        SELECT 'knowledge_base' AS table_name, 'domain:status' AS rule, count(*) FILTER (status = 'ARCHIVED') AS violations FROM v_kb
        UNION ALL SELECT 'knowledge_base', 'unique:slug', count(*) FROM (SELECT substr(kb_id, 4)::INT % 7 FROM v_kb GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'user', 'unique:email', count(*) FROM (SELECT user_id % 1001 FROM v_user_role GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'member', 'unique:member', count(*) FROM (SELECT kb_id, CASE WHEN user_id % 40 >= 20 AND user_id % 3 = 0 THEN user_id - 20 ELSE user_id END FROM v_member GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'document', 'domain:status', count(*) FILTER (doc_id % 43 = 0) FROM v_document
        UNION ALL SELECT 'document', 'unique:document_kb', 0
        UNION ALL SELECT 'version', 'range:version_number', count(*) FILTER (version_number <= 0) FROM p_version
        UNION ALL SELECT 'version', 'range:ingest_version', count(*) FILTER (version_id % 29 = 0) FROM v_version
        UNION ALL SELECT 'version', 'range:chunk_count', count(*) FILTER (version_id % 31 = 0) FROM v_version
        UNION ALL SELECT 'version', 'domain:status', count(*) FILTER (version_id % 37 = 0) FROM v_version
        UNION ALL SELECT 'version', 'domain:vectorization_status', count(*) FILTER (version_id % 41 = 0) FROM v_version
        UNION ALL SELECT 'version', 'unique:version_number', count(*) FROM (SELECT doc_id, version_number FROM p_version GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'version', 'unique:version_document', 0
        UNION ALL SELECT 'version', 'reference:document', count(*) FROM p_version WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'job', 'range:attempts', count(*) FILTER (attempts < 0) FROM p_job
        UNION ALL SELECT 'job', 'range:max_attempts', count(*) FILTER (max_attempts <= 0) FROM p_job
        UNION ALL SELECT 'job', 'range:attempts_lte_max', count(*) FILTER (attempts > max_attempts) FROM p_job
        UNION ALL SELECT 'job', 'domain:status', count(*) FILTER (job_id % 59 = 0) FROM v_job
        UNION ALL SELECT 'job', 'reference:version', count(*) FILTER (version_id IS NULL) FROM p_job
        UNION ALL SELECT 'chunk', 'range:chunk_no', count(*) FILTER (chunk_no <= 0) FROM p_chunk
        UNION ALL SELECT 'chunk', 'range:token_count', count(*) FILTER (line % 7 = 0) FROM p_chunk
        UNION ALL SELECT 'chunk', 'nonblank:chunking_strategy', count(*) FILTER (line % 11 = 0) FROM p_chunk
        UNION ALL SELECT 'chunk', 'nonblank:chunking_version', count(*) FILTER (doc_id % 19 = 0) FROM p_chunk
        UNION ALL SELECT 'chunk', 'nonblank:checksum', count(*) FILTER (line % 17 = 0) FROM p_chunk
        UNION ALL SELECT 'chunk', 'json:metadata_json', count(*) FILTER (line % 5 IN (1, 2)) FROM p_chunk
        UNION ALL SELECT 'chunk', 'vector:embedding', count(*) FILTER (line % 6 = 0 OR (line % 3 <> 0 AND line % 10 = 1)) FROM p_chunk
        UNION ALL SELECT 'chunk', 'unique:live_chunk', count(*) FROM (SELECT version_id, chunk_no FROM p_chunk WHERE doc_id % 2 = 0 GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'chunk', 'unique:chunk_document', 0
        UNION ALL SELECT 'chunk', 'reference:document_kb', count(*) FILTER (kb_id = 'other') FROM p_chunk
        UNION ALL SELECT 'chunk', 'reference:version_document', count(*) FROM p_chunk c WHERE NOT EXISTS (SELECT 1 FROM p_version v WHERE v.version_id = c.version_id AND v.doc_id = c.doc_id)
        UNION ALL SELECT 'message', 'json:usage_json', count(*) FILTER (turn % 3 = 1) FROM v_message
        UNION ALL SELECT 'message', 'json:retrieval_meta_json', count(*) FILTER (turn % 4 = 1) FROM v_message
        UNION ALL SELECT 'citation', 'unique:citation', count(*) FROM (SELECT message_id, chunk_id FROM p_citation GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'citation', 'reference:chunk_document', count(*) FROM p_citation c WHERE moved OR chunk_id NOT IN (SELECT chunk_id FROM v_line_chunk)
        UNION ALL SELECT 'eval_run', 'json:retrieval_config_json', count(*) FILTER (item_id % 5 IN (0, 1)) FROM benchmark
        UNION ALL SELECT 'eval_run', 'json:summary_json', count(*) FILTER (item_id % 5 = 1) FROM benchmark
        UNION ALL SELECT 'eval_run', 'reference:set_kb', count(*) FILTER (item_id % 7 = 0) FROM benchmark
        UNION ALL SELECT 'eval_item', 'json:retrieved_sources_json', count(*) FILTER (item_id % 6 IN (0, 1)) FROM benchmark
        UNION ALL SELECT 'eval_item', 'json:usage_json', count(*) FILTER (item_id % 6 = 1) FROM benchmark
        UNION ALL SELECT 'eval_item', 'unique:item', count(*) FROM (SELECT item_id % 3, item_id // 4 FROM benchmark GROUP BY ALL HAVING count(*) > 1)""",
}


@query("q12_rule_catalogue", "SELECT table_name, rule, violations FROM broken", VIEWS)
def _(c):
    return rules.check_all(planted(c))
