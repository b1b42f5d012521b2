"""The stored index and chunk table, duplicates under skew, upserts, compatibility forms, hooks that fail."""

import time

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_retrieval import NOW, chunk_rows, question

from groundwell.functions import hooks
from groundwell.functions import text as T
from groundwell.operators import dedup, lexical, lifecycle, rules, semantic
from groundwell.operators.index import ChunkIndex, add_segment, prefix_terms
from groundwell.plans.views import Corpus
from groundwell.sources.ranges import running_total
from groundwell.sources.tables import settle, shared_dir, upsert_by_key


def files_below(spark, path):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = {}
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            out[f.getPath().toString()] = f.getModificationTime()
    return out


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n}


# --- written results --------------------------------------------------------------------------------------------------
def test_a_written_result_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    rows = rows.join(rows.withColumnRenamed("count", "again"), "k").repartition("again")
    before = shuffle_files(spark)
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    written = settle(rows, "test")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and written.count() == 700 and rows.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


# --- index ------------------------------------------------------------------------------------------------------------
def test_running_total_over_ranges(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(300)], "k int, w int").repartition(5)
    got = {(r["k"], r["w"]): r["before"] for r in running_total(rows, ["k", "w"], F.col("w"), rows_per_part=40).collect()}
    total = 0
    for key in sorted(got):
        assert got[key] == total
        total += key[1]


def test_prefix_is_one_interval_of_the_sorted_dictionary(spark):
    words = [f"{a}{b}{c}" for a in "abé" for b in "xyz漢" for c in range(12)]
    index = add_segment(chunk_rows(spark, [" ".join(words[i::5]) for i in range(5)]), shared_dir(spark, "index"), rows_per_part=2)
    terms = {r["key"] for r in index.table("terms").collect()}
    assert index.table("terms").count() == len(terms) and terms == {r["term"] for r in index.postings.collect()}
    asked = ["a", "b", "éx", "bz1", "by11", "zz", "é漢", words[0], words[-1], "\x01", "漢"]
    got = {(r["prefix"], r["term"]) for r in prefix_terms(index, spark.createDataFrame([(p,) for p in asked], "prefix string")).collect()}
    assert got == {(p, t) for p in asked for t in terms if t.startswith(p)}


def test_a_new_segment_closes_old_versions_and_rewrites_no_file(spark):
    root = shared_dir(spark, "index")
    add_segment(chunk_rows(spark, ["alpha queue", "beta queue"]), root)
    before = files_below(spark, root)
    fresh = chunk_rows(spark, ["alpha worker queue queue"]).withColumn("chunk_id", F.lit("new"))
    index = add_segment(fresh, root, segment=1)
    assert before.items() <= files_below(spark, root).items()
    asked = lexical.query_clauses(T.preprocess(question(spark, "queue worker")))
    assert {r["chunk_id"]: r["matched_positions"] for r in lexical.lexical_matches(asked, index).collect()} == {"new": 3, "c1": 1}


def test_matching_reads_postings_and_no_text(spark):
    index = add_segment(chunk_rows(spark, ["alpha queue", "beta queue"]), shared_dir(spark, "index"))
    plan = lexical.lexical_topk(lexical.lexical_matches(lexical.query_clauses(T.preprocess(question(spark, '"alpha queue" beta'))), index))
    scans = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line]
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert scans and "content" not in physical and "search_text:" not in physical


def test_far_blocks_are_skipped_and_the_result_is_exact(spark):
    rng = np.random.default_rng(1)
    centers = np.eye(8)[:6] * 5
    data = np.concatenate([c + rng.normal(scale=0.05, size=(120, 8)) for c in centers])
    rows = [(f"c{i}", i, "kb", "en", NOW, "m", 8, v.tolist()) for i, v in enumerate(data)]
    right = spark.createDataFrame(rows, "chunk_id string, doc_id bigint, kb_id string, language string, indexed_at timestamp, embedding_model string, embedding_dim int, embedding array<double>")
    root = shared_dir(spark, "vectors")
    semantic.add_vectors(right.withColumn("seq", F.col("doc_id")), root, block_rows=30, part_rows=400)
    index = ChunkIndex(spark, root)
    asked = [(q, "kb", "m", 8, (centers[q % 6] + 0.01).tolist(), [], []) for q in range(4)] + [(9, "kb", "m", 8, centers[1].tolist(), [3, 700], [])]
    left = spark.createDataFrame(asked, "query_id bigint, kb_id string, embedding_model string, embedding_dim int, embedding array<double>, document_ids array<bigint>, languages array<string>")
    _, later = semantic.pruned_search(left, index, 10)
    blocks = index.blocks.count()
    looked = {r["query_id"]: r["count"] for r in later.groupBy("query_id").count().collect()}
    assert blocks >= 20 and all(looked.get(q, 0) <= blocks // 2 for q in range(4))  # a filter that leaves fewer than k looks everywhere
    got = {(r["query_id"], r["semantic_rank"]): r["chunk_id"] for r in semantic.semantic_topk(left, index, 10).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(4):
        v = np.array(asked[q][4])
        best = np.argsort(np.round(1 - unit @ (v / np.linalg.norm(v)), 12), kind="stable")[:10]
        assert [got[(q, n + 1)] for n in range(10)] == [f"c{i}" for i in best]
    assert {got[(9, 1)], got[(9, 2)]} == {"c3", "c700"} and (9, 3) not in got


# --- chunk table ------------------------------------------------------------------------------------------------------
def test_a_batch_rewrites_only_the_partitions_of_its_versions(spark):
    rows = spark.createDataFrame([(f"c{v}-{n}", v, n, f"{v % 3:03d}") for v in range(30) for n in range(2)], "chunk_id string, version_id long, chunk_no long, kb_id string")
    store = lifecycle.ChunkStore(spark, shared_dir(spark, "store"), buckets=8)
    store.create(rows.withColumn("superseded_at", F.lit(None).cast("timestamp")))
    before = files_below(spark, f"{store.root}/data")
    batch = spark.createDataFrame([("n1", 4, 0, "001"), ("n2", 31, 0, "009")], "chunk_id string, version_id long, chunk_no long, kb_id string")
    store.supersede(batch, F.lit("2025-01-01").cast("timestamp"))
    after = files_below(spark, f"{store.root}/data")
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 2
    moved = store.manifest().filter("generation = 1").count()
    assert moved == 2 and store.manifest().count() == len({p.rsplit("/", 1)[0].split("generation=")[1][2:] for p in after})
    live = {r["chunk_id"] for r in lifecycle.live_chunks(store.read()).collect()}
    assert live == {f"c{v}-{n}" for v in range(30) for n in range(2) if v != 4} | {"n1", "n2"}
    assert store.read().count() == 62 and {r["kb_id"] for r in store.read().collect()} == {"000", "001", "002", "009"}


def test_duplicates_of_a_hot_line_are_spread_over_the_tasks_that_read_it(spark):
    rows = spark.range(4000).select(F.col("id").alias("n"), F.lit("kb").alias("kb_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("checksum")).repartition(16)
    flagged = dedup.exact_duplicates(rows, ["kb_id"], [F.asc("n")])
    assert flagged.filter("NOT is_duplicate AND checksum = 'hot'").first()["n"] == 0 and flagged.filter("is_duplicate").count() == 1333
    met = rows.withColumn("task", F.spark_partition_id()).filter("checksum = 'hot'").groupBy("task").count()
    assert met.count() == 16  # one row of each is all that meets


def test_of_two_incoming_rows_the_newest_counts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 9), (3, "z", 1), (3, None, 2)], "k int, v string, at int")
    got = sorted(map(tuple, upsert_by_key(old, new, ["k"], F.col("at")).collect()))
    assert got == [(1, "y", 9), (2, "b", 1), (3, None, 2)]


# --- rules ------------------------------------------------------------------------------------------------------------
def test_rules_count_what_breaks_them_and_let_null_pass(spark):
    catalogue = {
        "a": rules.Rules(ranges={"n": "n > 0"}, nonblank=("s",), json_objects=("j", "r"), required=("r",), domains={"s": ["x", " "]}, unique={"n": ["n"], "s": ["lower(s)"]}, unique_where={"s": "n = 1"}, references={"b": ("b", ["n", "s"])}),
    }
    rows = [(1, "x", "{}", "{}"), (1, "X", "[]", None), (0, " ", None, "1"), (None, None, "{", "{}")]
    tables = {"a": spark.createDataFrame(rows, "n int, s string, j string, r string"), "b": spark.createDataFrame([(1, "x")], "n int, s string")}
    got = {r["rule"]: r["violations"] for r in rules.check_all(tables, catalogue=catalogue).collect()}
    assert got == {"range:n": 1, "nonblank:s": 1, "json:j": 2, "json:r": 2, "domain:s": 1, "unique:n": 1, "unique:s": 1, "reference:b": 2}


# --- compatibility forms and hooks -------------------------------------------------------------------------------------
def test_full_width_and_ligatures_meet_their_plain_spelling(spark):
    rows = spark.createDataFrame([("ＡＢＣ ﬁle.txt",), ("plain file",), (None,)], "name string")
    assert [r["filename"] for r in T.with_safe_filename(rows, "name").collect()] == ["ABC-file.txt", None, None]
    assert T.with_terms(rows, "name").first()["terms"] == ["abc", "file.txt"]
    assert T.with_terms(rows, "name", significant=True).first()["terms"] == ["abc", "file", "txt"]


def test_a_failing_call_is_an_error_row_and_the_rest_goes_on(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts][: 1 if any("short" in t for t in texts) else None]

    rows = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "cc"), (4, "short"), (5, "x" * 400), (6, None)], "id int, content string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["embedding_error"]) for r in hooks.embed_texts(rows, picky, "m", batch_items=1).collect()}
    assert got == {1: ([2.0], None), 2: (None, "OPENAI_EMBEDDING_FAILED"), 3: ([2.0], None), 4: ([5.0], None), 5: ([400.0], None), 6: ([0.0], None)}
    pairs = hooks.embed_texts(rows.filter("id IN (1, 4)"), picky, "m", batch_items=2).collect()
    assert {r["embedding_error"] for r in pairs} == {"OPENAI_EMBEDDING_FAILED"}
    answers = hooks.answer_prompts(rows, lambda part: [str(x) for x in picky(part)], "content", batch_items=1).collect()
    assert [r["id"] for r in answers if r["answer_error"]] == [2, 6]
    parsed = hooks.parse_files(rows.select(F.col("id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")), lambda b: [(None, str(len(b)))]).collect()
    assert [(r["doc_id"], r["error_code"]) for r in parsed if r["error_code"]] == [(6, "FILE_PARSE_FAILED")]


@pytest.mark.parametrize("sizes,items,tokens,want", [([4] * 5, 2, 99, [2, 2, 1]), ([40, 40, 40], 9, 20, [2, 1]), ([400, 4], 9, 20, [1, 1]), ([], 3, 3, [])])
def test_calls_hold_bounded_items_and_tokens(sizes, items, tokens, want):
    assert [len(p) for p in hooks._packed(["x" * n for n in sizes], items, tokens)] == want


def test_chunks_and_postings_of_an_index_are_written_where_they_are_read(spark, monkeypatch):
    plans = {}
    write = DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        plans[path.split("/")[-2]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    corpus = Corpus(spark, "/root/testdata/sf0.001")
    corpus._tables["documents"] = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = add_segment(corpus.live_line_chunks, shared_dir(spark, "index"), rows_per_part=7)
    assert "Exchange" not in plans["chunks"] and "Exchange" not in plans["postings"]
    held = index.postings.select("part", F.explode("seqs").alias("s")).groupBy("part").agg(F.countDistinct("s").alias("n"))
    assert held.agg(F.max("n")).first()[0] == 7


def test_a_part_is_bounded_and_of_one_knowledge_base(spark):
    rows = chunk_rows(spark, [f"queue w{i}" for i in range(40)]).withColumn("kb_id", F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string"))).coalesce(1)
    index = add_segment(rows, shared_dir(spark, "index"), rows_per_part=5)
    held = index.postings.select("part", "kb_id", F.explode("seqs").alias("seq")).groupBy("part").agg(F.countDistinct("seq").alias("n"), F.countDistinct("kb_id").alias("kbs")).collect()
    assert max(r["n"] for r in held) <= 5 and {r["kbs"] for r in held} == {1} and len(held) == 9
    assert index.postings.select(F.explode("seqs").alias("seq")).distinct().count() == 40


def test_lines_are_collapsed_once_and_blank_ones_left_out(spark, tmp_path):
    text = " A  b\u2003C \n\u2003\u00a0\n\t\n\nd\u00a0 E"
    rows = [(2, text, "en", "src1"), (4, None, "en", "src1"), (6, "\u3000", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = Corpus(spark, str(tmp_path)).line_chunks
    got = [(r["chunk_no"], r["content"], r["search_text"], r["section_title"]) for r in lines.orderBy("chunk_no").collect()]
    assert got == [(1, " A  b\u2003C ", "a b c", "A b C"), (5, "d\u00a0 E", "d e", "d E")]
    assert lines._jdf.queryExecution().executedPlan().toString().count("regexp_replace(line") == 1
