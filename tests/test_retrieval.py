import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as T
from groundwell.operators import dedup, hybrid, lexical, semantic
from groundwell.operators.index import ChunkIndex, add_segment, prefix_terms
from groundwell.sources.tables import shared_dir

NOW = dt.datetime(2024, 5, 1)


def chunk_rows(spark, texts, **extra):
    rows = [{
        "chunk_id": f"c{i}", "doc_id": i, "version_id": extra.get("version", i), "kb_id": "kb", "chunk_no": i, "content": t,
        "search_text": t.lower(), "checksum": f"s{i}", "section_title": None, "page_number": 1, "source_title": "guide",
        "document_title": "guide", "language": "en", "metadata_json": None, "indexed_at": NOW,
    } for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, (
        "chunk_id string, doc_id bigint, version_id bigint, kb_id string, chunk_no bigint, content string, search_text string, "
        "checksum string, section_title string, page_number bigint, source_title string, document_title string, "
        "language string, metadata_json string, indexed_at timestamp"))


def question(spark, text, languages=()):
    return spark.createDataFrame(
        [(1, "kb", text, [], list(languages))],
        "query_id bigint, kb_id string, question string, document_ids array<bigint>, languages array<string>")


def positions(spark, text, texts):
    index = add_segment(chunk_rows(spark, texts), shared_dir(spark, "index"), rows_per_part=2)
    found = lexical.lexical_matches(lexical.query_clauses(T.preprocess(question(spark, text))), index)
    return {r.chunk_id: r.matched_positions for r in found.collect()}


def test_prefixes_match_and_positions_count_once(spark):
    assert positions(spark, "work worker", ["worker works", "a queue", "work"]) == {"c0": 2, "c2": 1}


def test_phrase_needs_neighbours(spark):
    assert positions(spark, '"reset worker"', ["reset worker now", "reset the worker", "reset workers reset worker"]) == {"c0": 1, "c2": 2}


def test_phrase_start_already_counted_is_not_counted_twice(spark):
    assert positions(spark, '"reset worker" res', ["reset worker"]) == {"c0": 1}


def test_long_prefix_beyond_the_join_key(spark):
    word = "x" * 40
    assert positions(spark, word, [word + "tail", "x" * 35]) == {"c0": 1}


def test_exact_knn_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    chunks = [(f"c{i}", i, "kb", "en", NOW, "m", 8, rng.normal(size=8).tolist()) for i in range(200)]
    queries = [(q, "kb", "m", 8, rng.normal(size=8).tolist(), [], []) for q in range(7)]
    left = spark.createDataFrame(queries, "query_id bigint, kb_id string, embedding_model string, embedding_dim int, embedding array<double>, document_ids array<bigint>, languages array<string>")
    right = spark.createDataFrame(chunks, "chunk_id string, doc_id bigint, kb_id string, language string, indexed_at timestamp, embedding_model string, embedding_dim int, embedding array<double>")
    root = shared_dir(spark, "vectors")
    semantic.add_vectors(right.withColumn("seq", F.col("doc_id")), root, block_rows=20, part_rows=90)
    cut = semantic.semantic_topk(left, ChunkIndex(spark, root), 5, query_rows=2)
    got = {(r.query_id, r.semantic_rank): r.chunk_id for r in cut.collect()}
    matrix = np.array([c[7] for c in chunks])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    for q in queries:
        vector = np.array(q[4]) / np.linalg.norm(q[4])
        best = np.argsort(1 - matrix @ vector)[:5]
        assert [got[(q[0], n + 1)] for n in range(5)] == [f"c{i}" for i in best]


def scored(spark, candidates, texts, text="reset worker", **extra):
    merged = spark.createDataFrame(
        [(1, c, d, r) for c, d, r in candidates],
        "query_id bigint, chunk_id string, semantic_distance double, lexical_raw double",
    ).withColumn("semantic_rank", F.when(F.col("semantic_distance").isNotNull(), 1)).withColumn(
        "lexical_rank", F.when(F.col("lexical_raw").isNotNull(), 1)).withColumn("retrieved_by", hybrid.provenance())
    as_of = F.lit("2024-06-01").cast("timestamp")
    return hybrid.rerank(hybrid.score_candidates(merged, T.preprocess(question(spark, text)), chunk_rows(spark, texts, **extra), as_of))


def test_semantic_beats_weak_lexical(spark):
    rows = scored(spark, [("c0", 0.1, None), ("c1", None, 0.05)], ["other words", "reset nothing"]).orderBy("rank_before_dedup").collect()
    assert [r.chunk_id for r in rows] == ["c0", "c1"]


def test_ties_go_by_id(spark):
    rows = scored(spark, [("c1", 0.2, None), ("c0", 0.2, None)], ["same text", "same text"]).orderBy("rank_before_dedup").collect()
    assert [r.chunk_id for r in rows] == ["c0", "c1"]


def test_adjacent_near_duplicate_is_suppressed(spark):
    text = "reset worker queue when depth grows beyond threshold and operators notice alarms"
    rows = {r.chunk_id: r for r in dedup.suppress_duplicates(
        scored(spark, [("c0", 0.1, 0.2), ("c1", 0.2, 0.2), ("c2", 0.3, None)], [text, text + " x", "something else"], version=9)).collect()}
    assert rows["c0"].rank_after_dedup == 1 and rows["c2"].rank_after_dedup == 2
    assert rows["c1"].rank_after_dedup is None and rows["c1"].dedup_reason == "near-duplicate of c0"


@pytest.mark.parametrize("name", ["r11_retrieve", "j05_lexical_pairs", "a11_user_filters"])
def test_no_cartesian_product(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
