"""Exact duplicates: local, salted and global combining, with the full content as part of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import keep_rows, settle

#: characters that do not count when texts are compared: blank and \x09-\x0D
IGNORED = " \t\n\x0b\x0c\r"
#: a row's rank in its group: code points, then the smaller doc_id; 20 digits hold any doc_id, a null one is last
_SHIFT = "100000000000000000000"
_TOP = "9223372036854775808"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _rank(points: Column, doc_id: Column) -> Column:
    turned = F.expr(f"cast({_TOP} as decimal(20,0))") - doc_id.cast("decimal(20,0)")
    return (points.cast("decimal(11,0)") * F.expr(f"cast({_SHIFT} as decimal(21,0))") + F.coalesce(turned, F.lit(0))).cast("decimal(38,0)")


def row_hash() -> Column:
    """Tells rows of docs apart by doc_id and original text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def kept_rows(docs: DataFrame) -> DataFrame:
    """Rows of docs that stay: one of each group of equal texts; all columns, unchanged."""
    return keep_rows(docs, row_hash(), exact_groups(docs).filter("kept").select("row_hash"), once=True)


def exact_groups(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal when they are identical without blanks and \\x09-\\x0D; a null text is empty. Of equal texts the row
    with the most code points stays, then the smallest doc_id; a null doc_id comes last. Of rows that repeat doc_id and
    text, all carry the same keep_id and one is kept. Other columns of docs are ignored.

    Copies meet in three steps: in each input task (partial aggregation), in each of `salts` parts of a digest, and over
    the parts. Every step groups by digest *and* text, so a digest collision never merges two texts; digests that stand
    for several texts are found by counting and joined by text instead. A group of any size costs a row per task and salt.
    `digest` maps the normalized text to the join key (SHA-256 by default).
    """
    digest = digest or (lambda text: F.sha2(text, 256))

    def rows() -> DataFrame:
        text = normalized(F.col("text"))
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), text.alias("norm"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), row_hash().alias("row_hash")
        )

    def classes(source: DataFrame) -> DataFrame:
        salted = (
            source.withColumn("salt", F.pmod(F.xxhash64("doc_id", "points"), F.lit(salts)))
            .groupBy("digest", "norm", "salt").agg(F.max(_rank(F.col("points"), F.col("doc_id"))).alias("rank"), F.count(F.lit(1)).alias("copies"))
        )
        return salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("copies").alias("group_size"))

    best = settle(classes(rows()).select("digest", "rank", "group_size"), "exact-classes")
    collided = best.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    if collided.isEmpty():
        joined = rows().drop("norm").join(best, "digest")
    else:
        odd = rows().join(collided, "digest", "left_semi")
        plain = rows().join(collided, "digest", "left_anti").drop("norm").join(best, "digest")
        joined = plain.unionByName(odd.join(classes(odd), ["digest", "norm"]).drop("norm"))
    rest = F.expr(f"rank % cast({_SHIFT} as decimal(21,0))")
    keep_id = F.when(rest > 0, (F.expr(f"cast({_TOP} as decimal(20,0))") - rest).cast("long"))
    same = Window.partitionBy("doc_id", "text_sha256", "points").orderBy(F.lit(1))
    wins = (_rank(F.col("points"), F.col("doc_id")) == F.col("rank")) & (F.row_number().over(same) == 1)
    return joined.select("doc_id", keep_id.alias("keep_id"), "group_size", wins.alias("kept"), "text_sha256", "row_hash")


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
