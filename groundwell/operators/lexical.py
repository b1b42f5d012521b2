"""Full-text candidates: prefix clauses of a question matched against stored postings.

A query word matches every corpus word it is a prefix of. Postings are joined on the knowledge base and the first two characters:
what a batch of questions asks for is small and goes to the postings, which are read where they lie, so neither they nor the many
terms of a short prefix are shuffled. Counts are added up before any column of a chunk is read, and phrases are checked on
positions; no text is read at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T
from groundwell.operators import scope
from groundwell.operators.index import ChunkIndex, chunk_keys, scoped_postings
from groundwell.sources.tables import settle

RANK_PER_POSITION = 0.1


def _clause_words(terms: Column) -> Column:
    words = F.array_distinct(F.flatten(F.transform(terms, T.words_by_position)))
    return F.filter(words, lambda w: F.length(w) >= 2)


def query_clauses(prepared: DataFrame) -> DataFrame:
    """Add `word_clauses` (prefixes, any may match) and `phrase_clauses` (prefixes in sequence)."""
    phrases = F.transform(
        F.col("phrases"),
        lambda p: F.filter(F.flatten(F.transform(T.terms(p), T.words_by_position)), lambda w: F.length(w) >= 2),
    )
    return prepared.select(
        "*",
        _clause_words(F.array_except("tokens", T.phrase_terms(F.col("phrases")))).alias("word_clauses"),
        F.filter(phrases, lambda p: F.size(p) > 0).alias("phrase_clauses"),
    )


def _wanted(clauses: DataFrame) -> DataFrame:
    """One row per question and prefix: of a word clause (`clause` is null), or the place `at` in a phrase of `size` words."""
    asked = clauses.select("query_id", "kb_id", "word_clauses", "phrase_clauses")
    none = F.lit(None).cast("int")
    by_word = asked.select("query_id", "kb_id", F.explode("word_clauses").alias("prefix")).select("*", none.alias("clause"), none.alias("at"), none.alias("size"))
    phrases = asked.select("query_id", "kb_id", F.posexplode("phrase_clauses").alias("clause", "words"))
    by_phrase = phrases.select("query_id", "kb_id", "clause", F.size("words").alias("size"), F.posexplode("words").alias("at", "prefix"))
    return by_word.unionByName(by_phrase)


def _phrase_starts(rows: pa.Table) -> pa.Table:
    """How many positions of each chunk begin a phrase of one question and are not counted as words, within one part."""
    begins: list[np.ndarray] = []
    rows = rows.combine_chunks()
    empty = pa.schema([("query_id", rows.schema.field("query_id").type), ("seq", pa.int64()), ("hits", pa.int64())])
    clause, at, size, counted = (rows[c].to_numpy(zero_copy_only=False) for c in ("clause", "at", "size", "word_hit"))
    seqs, counts, places = (rows[c].chunk(0) if rows.num_rows else None for c in ("seqs", "counts", "places"))
    if not rows.num_rows:
        return empty.empty_table()
    row_of = np.repeat(np.arange(rows.num_rows), np.diff(seqs.offsets.to_numpy()))  # of each chunk of a posting
    chunk, chunk_of = np.unique(seqs.flatten().to_numpy(), return_inverse=True)
    sizes = counts.flatten().to_numpy()
    cell_of, place = np.repeat(np.arange(len(sizes)), sizes), places.flatten().to_numpy().astype(np.int64)
    width = np.int64(place.max() + 1 + size.max())
    row_of, key = row_of[cell_of], chunk_of[cell_of] * width + place
    for c in np.unique(clause):
        words = int(size[clause == c][0])
        found = None
        for j in range(words):
            rows_j = (clause == c) & (at == j)
            if j == 0:
                rows_j = rows_j & ~counted
            keys = key[rows_j[row_of]] - j
            found = np.unique(keys) if found is None else np.intersect1d(found, keys)
        begins.append(found)
    hits, count = np.unique(np.unique(np.concatenate(begins)) // width, return_counts=True)
    return pa.table({"query_id": pa.array([rows["query_id"][0].as_py()] * len(hits), empty.field("query_id").type), "seq": chunk[hits], "hits": count}, schema=empty)


def lexical_matches(clauses: DataFrame, index: ChunkIndex) -> DataFrame:
    """(query_id, chunk_id, indexed_at, matched_positions, lexical_raw) for every chunk matching a clause.

    A position counts once per question, whether a word clause or a phrase start hits it.
    """
    clauses = settle(clauses.select("query_id", "kb_id", "document_ids", "languages", "word_clauses", "phrase_clauses"), "clauses")
    wanted = settle(_wanted(clauses).withColumn("head", F.substring("prefix", 1, 2)), "wanted")
    # a term counts once for a question, however many of its words it begins with
    words = wanted.filter("clause IS NULL").groupBy("query_id", "kb_id", "head").agg(F.collect_set("prefix").alias("prefixes"))
    by_word = (
        scoped_postings(index, settle(words, "words"), F.exists("prefixes", lambda p: F.startswith("term", p)))
        .select("query_id", F.inline(F.arrays_zip("seqs", "counts"))).select("query_id", F.col("seqs").alias("seq"), F.col("counts").cast("long").alias("hits"))
    )
    phrases = wanted.filter("clause IS NOT NULL").join(clauses.select("query_id", "word_clauses"), "query_id")
    id_type = clauses.schema["query_id"].dataType.simpleString()
    by_phrase = (
        scoped_postings(index, settle(phrases, "phrases"), F.startswith("term", "prefix"))
        .withColumn("word_hit", F.exists("word_clauses", lambda p: F.startswith("term", p)))
        .select("query_id", "part", "clause", "at", "size", "word_hit", "seqs", "counts", F.flatten("positions").alias("places"))
        .groupBy("query_id", "part").applyInArrow(_phrase_starts, f"query_id {id_type}, seq long, hits long")
    )
    hits = by_word.unionByName(by_phrase).groupBy("query_id", "seq").agg(F.sum("hits").alias("matched_positions"))
    return (
        hits.join(chunk_keys(index), "seq").join(clauses.select("query_id", "document_ids", "languages"), "query_id")
        .filter(scope.filter_match())
        .select("query_id", "chunk_id", "indexed_at", "matched_positions")
        .withColumn("lexical_raw", F.col("matched_positions") * RANK_PER_POSITION)
    )


def lexical_topk(matches: DataFrame, k: int = V.CANDIDATE_LIMIT) -> DataFrame:
    """The k best matches per question; a question without clauses has no rows."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("lexical_raw"), F.desc_nulls_last("indexed_at"), F.asc("chunk_id")
    )
    return (
        matches.withColumn("lexical_rank", F.row_number().over(order))
        .filter(F.col("lexical_rank") <= k)
        .select("query_id", "chunk_id", "lexical_raw", "lexical_rank")
    )
