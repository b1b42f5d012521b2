"""Normalization of block text and the quality gate. Everything here is an expression over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import text as T

FLAGS = ["dehyphenated_breaks", "soft_wrap_joins", "blank_runs_collapsed", "noise_lines_removed"]


def clean_chars(text: Column) -> Column:
    """Line feeds only, no control, format or unassigned characters but tab, no blanks before a line end."""
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"[\p{C}&&[^\n\t]]", "")
    return F.regexp_replace(unified, r"[ \t]+\n", "\n")


_BROKEN_WORD = r"(?U)(?<=\w)-\n(?=\w)"


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, _BROKEN_WORD, "")


def normalize_line(line: Column, kind: Column) -> Column:
    cells = F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda x: x != "")
    as_row = F.array_join(F.transform(cells, lambda x: F.regexp_replace(x, r"\t", " ")), " | ")
    return F.when(kind == "table_row", as_row).otherwise(T.strip(F.regexp_replace(line, r"[ \t]+", " ")))


def is_noise(line: Column) -> Column:
    return (F.length(F.regexp_replace(line, r"(?U)\s+", "")) >= 4) & ~line.rlike(r"[\p{L}\p{N}]")


def render(lines: Column, kind: Column) -> Column:
    """Join cleaned lines: one per line for headings, questions and table rows, one blank for list items,
    soft wraps undone for paragraphs."""
    filled = F.filter(lines, lambda x: x != "")
    segments = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", ""), r"\n{2,}")
    paragraphs = F.array_join(
        F.transform(F.filter(segments, lambda s: s != ""), lambda s: F.replace(s, F.lit("\n"), F.lit(" "))), "\n\n"
    )
    text = (
        F.when(kind.isin("heading", "qa_pair", "table_row"), F.array_join(filled, "\n"))
        .when(kind == "list_item", F.array_join(filled, " ")).otherwise(paragraphs)
    )
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return T.strip(text)


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Normalized text per block with its flags; blocks left without text stay, with text ''.

    Blocks that carry `nfkc_text` are normalized from it; others get their normal form here.

    Adds raw_text, lines_removed and normalization_flags (sorted, distinct).
    """
    staged = blocks.withColumn("raw_text", F.col("text"))
    if "nfkc_text" in blocks.columns:
        staged = staged.withColumn("text", F.col("nfkc_text")).drop("nfkc_text")
    else:
        staged = T.with_nfkc(staged, "text")
    kind = F.col("kind")
    staged = staged.withColumn("text", clean_chars(F.coalesce("text", F.lit(""))))
    staged = staged.withColumn("dehyphenated", F.col("text").rlike(_BROKEN_WORD)).withColumn(
        "lines", F.transform(F.split(dehyphenate(F.col("text")), "\n"), lambda x: normalize_line(x, kind))
    )
    staged = staged.withColumn("kept", F.filter("lines", lambda x: ~is_noise(x)))
    joined = F.array_join("kept", "\n")
    filled = F.size(F.filter("kept", lambda x: x != ""))
    paragraph = ~kind.isin("heading", "qa_pair", "table_row", "list_item")
    soft = F.when(paragraph, joined.rlike(r"[^\n]\n[^\n]")).otherwise((kind == "list_item") & (filled > 1))
    blank = paragraph & (F.size("kept") > 0) & (
        (F.get("kept", F.lit(0)) == "") | F.contains(F.concat(joined, F.lit("\n")), F.lit("\n\n\n"))
    )
    removed = F.size("lines") - F.size("kept")
    flags = F.array_compact(F.array(
        F.when(blank, F.lit("blank_runs_collapsed")), F.when(F.col("dehyphenated"), F.lit("dehyphenated_breaks")),
        F.when(removed > 0, F.lit("noise_lines_removed")), F.when(soft, F.lit("soft_wrap_joins")),
    ))
    return staged.select(
        *[c for c in blocks.columns if c not in ("text", "nfkc_text")], "raw_text", render(F.col("kept"), kind).alias("text"),
        removed.alias("lines_removed"), flags.alias("normalization_flags"),
    )


def normalization_summary(normalized: DataFrame) -> DataFrame:
    """Per document: blocks in and out, and how often each flag was raised."""
    def raised(flag: str) -> Column:
        return F.count_if(F.array_contains("normalization_flags", flag)).alias(flag)

    return normalized.groupBy("doc_id").agg(
        F.count("*").alias("blocks_in"), F.count_if(F.col("text") != "").alias("blocks_out"),
        raised("dehyphenated_breaks"), raised("soft_wrap_joins"), raised("blank_runs_collapsed"),
        F.sum("lines_removed").alias("noise_lines_removed"),
    )


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def nonspace_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


_COUNTED = ["raw_alnum", "raw_nonspace", "alnum", "nonspace"]


def _character_counts() -> dict[str, Column]:
    return {
        "raw_alnum": F.sum(alnum_count(F.col("raw_text"))), "raw_nonspace": F.sum(nonspace_count(F.col("raw_text"))),
        "alnum": F.sum(alnum_count(F.col("text"))), "nonspace": F.sum(nonspace_count(F.col("text"))),
    }


def _gate_code() -> Column:
    def poor(alnum: str, nonspace: str) -> Column:
        return (F.col(nonspace) >= 80) & (F.col(alnum) / F.greatest(F.col(nonspace), F.lit(1)) < 0.1)

    return (
        F.when(poor("raw_alnum", "raw_nonspace"), "LOW_QUALITY_EXTRACTION")
        .when(F.col("alnum") < 20, "EMPTY_DOCUMENT")
        .when(poor("alnum", "nonspace"), "LOW_QUALITY_EXTRACTION")
    )


def quality_gate(normalized: DataFrame) -> DataFrame:
    """Per document `error_code`: LOW_QUALITY_EXTRACTION, EMPTY_DOCUMENT or null when it may be indexed."""
    counts = normalized.groupBy("doc_id").agg(*[c.alias(n) for n, c in _character_counts().items()])
    return counts.withColumn("error_code", _gate_code())


def indexable_blocks(normalized: DataFrame) -> DataFrame:
    """Blocks with text, of documents that pass the gate. The counts are windows over the partitioning the
    blocks already have, so nothing is shuffled or read again."""
    whole = Window.partitionBy("doc_id")
    counted = normalized.select("*", *[c.over(whole).alias(n) for n, c in _character_counts().items()])
    return counted.filter(_gate_code().isNull() & (F.col("text") != "")).drop(*_COUNTED)
