"""Lines of a document to typed blocks.

Lines are exploded once and hashed once by `doc_id`; every window and grouping below is keyed by the
document, so the whole structuring, normalization and chunking of a document needs that one exchange.
A document is one cell of the input, which bounds what a task holds for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import text as T

# --- fixed values: line patterns ---------------------------------------------
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
QA_LINE = r"(?i)^(q(?:uestion)?|a(?:nswer)?)\s*[:.-]\s*(.+)$"
NUMBERED = r"(?i)^((?:section\s+)?(?:\d+(?:\.\d+){0,4}|[A-Z]|[IVXLC]+)[\).:]?)\s+(.+)$"
LIST_ITEM = r"^([-*+•◦▪]|(?:\d+|[a-zA-Z])[.)])\s+(.+)$"
HEADING_BODY = r"^[A-Z][A-Za-z0-9/&()' -]{2,}$"


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1; CRLF and CR count as line ends."""
    unified = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(F.split(unified, "\n")).alias("pos", "text"))
    return rows.withColumn("line_no", F.col("pos") + 1).drop("pos")


def split_paragraphs(text: Column) -> Column:
    unified = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.filter(F.transform(F.split(unified, r"\n\s*\n"), T.strip), lambda p: p != "")


def word_count(text: Column) -> Column:
    return F.size(F.split(T.strip(text), r"(?U)\s+"))


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def is_title(text: Column) -> Column:
    """Every run of letters starts upper-case and goes on lower-case."""
    return ~text.rlike(r"(^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")


def _drop_colons(text: Column) -> Column:
    return F.regexp_replace(text, ":+$", "")


def heading_body(text: Column) -> Column:
    """Whether the rest of a numbered line reads like a heading."""
    body = _drop_colons(T.strip(text))
    short = (body != "") & (word_count(body) <= 12) & (F.length(body) <= 120)
    return short & ~body.rlike(r"[.?!;]$") & (is_upper(body) | is_title(body) | body.rlike(HEADING_BODY))


def heading_heuristic(line: Column) -> Column:
    words = word_count(line)
    return (F.length(line) <= 140) & (
        (line.endswith(":") & (words <= 12)) | (is_title(line) & (words <= 12)) | (is_upper(line) & (words <= 10))
    )


def numbered_level(prefix: Column) -> Column:
    digits = F.size(F.regexp_extract_all(prefix, F.lit(r"\d+"), 0))
    dots = F.regexp_count(prefix, F.lit(r"\."))
    return F.when(digits > 0, F.least(digits, F.lit(6))).when(dots > 0, F.least(dots + 1, F.lit(6))).otherwise(1)


def table_cells(line: Column) -> Column:
    """Cells split at bars, else tabs, else runs of three blanks; empty when fewer than two."""
    def cells(pattern: str) -> Column:
        return F.filter(F.transform(F.split(line, pattern), T.strip), lambda x: x != "")

    found = (
        F.when(line.contains("|"), cells(r"\|")).when(line.contains("\t"), cells(r"\t+"))
        .when(line.rlike(r"\S\s{3,}\S"), cells(r"\s{3,}"))
    )
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<string>"))


def classify_line(line: Column) -> Column:
    """struct(kind, text, heading_level, qa_label, list_marker, column_count, source) of a stripped line;
    kind is null for plain text."""
    markdown = F.regexp_extract(line, MARKDOWN_HEADING, 1)
    label = F.upper(F.substring(F.regexp_extract(line, QA_LINE, 1), 1, 1))
    prefix, numbered_body = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, NUMBERED, 2)
    marker = F.regexp_extract(line, LIST_ITEM, 1)
    cells = table_cells(line)

    def block(kind: str, text: Column, source: str, **extra: Column) -> Column:
        none_int, none_str = F.lit(None).cast("int"), F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), text.alias("text"),
            extra.get("level", none_int).cast("int").alias("heading_level"),
            extra.get("label", none_str).alias("qa_label"), extra.get("marker", none_str).alias("list_marker"),
            extra.get("columns", none_int).cast("int").alias("column_count"), F.lit(source).alias("source"),
        )

    return (
        F.when(line == "", None)
        .when(line.startswith("#") & (markdown != ""), block(
            "heading", T.strip(F.regexp_extract(line, MARKDOWN_HEADING, 2)), "markdown", level=F.length(markdown)))
        .when(F.substring(line, 1, 1).isin("q", "Q", "a", "A") & (label != ""), block(
            "qa_pair", F.concat(label, F.lit(": "), T.strip(F.regexp_extract(line, QA_LINE, 2))), "faq_marker",
            label=label))
        .when((prefix != "") & heading_body(numbered_body), block(
            "heading", _drop_colons(line), "numbered", level=numbered_level(prefix)))
        .when(marker != "", block(
            "list_item", F.concat(marker, F.lit(" "), T.strip(F.regexp_extract(line, LIST_ITEM, 2))), "list_marker",
            marker=marker))
        .when(F.size(cells) >= 2, block(
            "table_row", F.array_join(cells, " | "), "table_delimiter", columns=F.size(cells)))
        .when(heading_heuristic(line), block("heading", _drop_colons(line), "heuristic", level=F.lit(1)))
    )


def lines_to_blocks(lines: DataFrame, nfkc: bool = False) -> DataFrame:
    """Blocks of documents from (doc_id, page_number, line_no, text).

    Neighbouring plain lines of a page fuse into a paragraph; a blank or structured line ends it. The end
    line of a paragraph is the line that ended it. Blocks are numbered from 0 within a document.

    With `nfkc` the blocks also carry `nfkc_text`. It is made per line, before the rows are exchanged by
    document: normal forms do not reach across a line feed, and a Python stage after the exchange would lose
    the partitioning and cost a second one.
    """
    line = T.strip(F.col("text"))
    rows = lines.select("doc_id", "page_number", "line_no", line.alias("line"), classify_line(line).alias("block"))
    rows = rows.withColumn("shown", F.coalesce("block.text", "line"))
    if nfkc:
        rows = T.with_nfkc(rows, "shown")
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    plain = (F.col("line") != "") & F.col("block").isNull()
    first_of_page = ~F.coalesce(F.lag("page_number").over(order).eqNullSafe(F.col("page_number")), F.lit(False)) \
        | F.lag("line_no").over(order).isNull()
    islands = rows.withColumn("plain", plain).withColumn(
        "island",
        F.sum((~plain | first_of_page).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn("last_line", F.max("line_no").over(Window.partitionBy("doc_id", "page_number")))
    fused = (
        islands.filter(F.col("line") != "").groupBy("doc_id", "page_number", "island", "plain")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", "line", "shown"))).alias("lines"),
            F.first("block", ignorenulls=True).alias("block"), F.max("last_line").alias("last_line"),
        )
    )
    joined = {c: F.array_join(F.transform("lines", lambda x: x[c]), "\n") for c in ("line", "shown")}
    normal_form = [joined["shown"].alias("nfkc_text")] if nfkc else []
    ended = F.least(F.element_at("lines", -1)["line_no"] + 1, F.col("last_line"))
    blocks = fused.select(
        "doc_id", "page_number",
        F.coalesce("block.kind", F.lit("paragraph")).alias("kind"),
        F.coalesce("block.text", joined["line"]).alias("text"), *normal_form,
        F.col("block.heading_level").alias("heading_level"), F.col("block.qa_label").alias("qa_label"),
        F.size("lines").alias("source_line_count"), F.col("lines")[0]["line_no"].alias("source_line_start"),
        F.when(F.col("plain"), ended).otherwise(F.col("lines")[0]["line_no"]).alias("source_line_end"),
    )
    number = Window.partitionBy("doc_id").orderBy("page_number", "source_line_start")
    return blocks.withColumn("block_no", F.row_number().over(number) - 1)


def margin_key(line: Column) -> Column:
    """Line with digits masked, or null when it cannot be a running header or footer."""
    key = F.regexp_replace(F.regexp_replace(F.lower(T.strip(line)), r"\d+", "#"), r"(?U)\s+", " ")
    sized = (F.length(key) >= 4) & (F.length(key) <= 120) & key.rlike("[^# ]")
    return F.when(sized, key)


def page_margin_keys(page_lines: DataFrame) -> DataFrame:
    """(doc_id, key) of lines found among the first or last two of at least 70 % of the pages (two at least)."""
    page = Window.partitionBy("doc_id", "page_number")
    filled = page_lines.filter(T.strip(F.col("text")) != "").select(
        "doc_id", "page_number", margin_key(F.col("text")).alias("key"),
        F.row_number().over(page.orderBy("line_no")).alias("from_top"),
        F.row_number().over(page.orderBy(F.desc("line_no"))).alias("from_bottom"),
    )
    pages = page_lines.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))
    seen = (
        filled.filter("(from_top <= 2 OR from_bottom <= 2) AND key IS NOT NULL")
        .groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("on_pages"))
    )
    needed = F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.7))
    return seen.join(pages, "doc_id").filter((F.col("pages") >= 2) & (F.col("on_pages") >= needed)).select("doc_id", "key")


def strip_margins(page_lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Page lines without outer blank lines and without the runs of margin lines at both ends.
    Documents without margin keys are returned as they are."""
    with_margins = keys.select("doc_id").distinct().withColumn("has_margins", F.lit(True))
    marked = (
        page_lines.withColumn("key", margin_key(F.col("text")))
        .join(keys.withColumn("is_margin", F.lit(True)), ["doc_id", "key"], "left")
        .join(with_margins, "doc_id", "left")
    )
    page = Window.partitionBy("doc_id", "page_number")
    filled = T.strip(F.col("text")) != ""
    first_filled = F.min(F.when(filled, F.col("line_no"))).over(page)
    last_filled = F.max(F.when(filled, F.col("line_no"))).over(page)
    staged = marked.withColumn("lo", first_filled).withColumn("hi", last_filled)
    body = F.col("is_margin").isNull() & F.col("line_no").between(F.col("lo"), F.col("hi"))
    staged = staged.withColumn("body_lo", F.min(F.when(body, F.col("line_no"))).over(page)).withColumn(
        "body_hi", F.max(F.when(body, F.col("line_no"))).over(page)
    )
    kept = F.col("has_margins").isNull() | F.col("line_no").between(F.col("body_lo"), F.col("body_hi"))
    return staged.filter(kept).select(*page_lines.columns)


def extraction_warnings(page_lines: DataFrame, stripped: DataFrame) -> DataFrame:
    """Per document: page counts, extracted characters, removed margin lines, and the warnings they raise."""
    filled = T.strip(F.col("text")) != ""
    pages = page_lines.groupBy("doc_id", "page_number").agg(
        F.bool_or(filled).alias("filled"), (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"),
        F.count_if(filled).alias("filled_lines"),
    )
    docs = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count_if("filled").alias("nonempty_pages"),
        F.sum("chars").alias("extracted_chars"), F.sum("filled_lines").alias("filled_lines"),
    )
    left = stripped.filter(filled).groupBy("doc_id").agg(F.count("*").alias("kept_lines"))
    removed = F.col("filled_lines") - F.coalesce("kept_lines", F.lit(0))
    warnings = F.array_compact(F.array(
        F.when(F.col("nonempty_pages") < F.col("page_count"), F.lit("some_pages_empty_after_text_extraction")),
        F.when(
            (F.col("extracted_chars") > 0) & (F.col("extracted_chars") / F.col("page_count") < 80),
            F.lit("low_text_density_pdf"),
        ),
        F.when(F.col("removed_margin_lines") > 0, F.lit("repeated_page_margins_removed")),
    ))
    return (
        docs.join(left, "doc_id", "left").withColumn("removed_margin_lines", removed)
        .drop("filled_lines", "kept_lines").withColumn("warnings", warnings)
    )


def table_rows(rows: DataFrame) -> DataFrame:
    """Render (doc_id, table_no, row_no, cells): the first row is a header when it is as wide as the second."""
    cells = F.filter(F.transform("cells", T.strip), lambda x: x != "")
    filled = rows.withColumn("cells", cells).filter(F.size("cells") > 0)
    order = Window.partitionBy("doc_id", "table_no").orderBy("row_no")
    numbered = filled.select(
        "*", F.row_number().over(order).alias("n"),
        F.first("cells").over(order).alias("first_row"),
        F.nth_value(F.size("cells"), 2).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second_width"),
    )
    has_header = F.size("first_row") == F.coalesce("second_width", F.lit(-1))
    labelled = F.zip_with("first_row", "cells", lambda h, v: F.concat(h, F.lit(": "), v))
    same_width = has_header & (F.size("cells") == F.size("first_row"))
    text = F.when(same_width, F.array_join(labelled, " | ")).otherwise(F.array_join("cells", " | "))
    return numbered.filter(~(has_header & (F.col("n") == 1))).select(
        "doc_id", "table_no", "row_no", F.lit("table_row").alias("kind"), text.alias("text"),
        F.size("cells").alias("column_count"),
    )


def styled_blocks(paragraphs: DataFrame) -> DataFrame:
    """Block kind of styled paragraphs (doc_id, seq, style, text): the style decides, else the text."""
    text = T.strip(F.col("text"))
    style = F.lower(T.strip(F.coalesce("style", F.lit(""))))
    level = F.regexp_extract(style, r"(?:^|\s)(\d+)(?:\s|$)", 1)
    rows = paragraphs.withColumn("line", text).filter(F.col("line") != "").withColumn(
        "found", classify_line(F.col("line"))
    )
    by_style, by_list = F.startswith(style, F.lit("heading")), style.contains("list")
    heading_level = F.when(by_style, F.when(level != "", F.least(level.cast("int"), F.lit(6))).otherwise(1)).when(
        ~by_list & (F.col("found.kind") == "heading"), 1
    )
    return rows.select(
        "doc_id", "seq",
        F.when(by_style, "heading").when(by_list, "list_item")
        .otherwise(F.coalesce("found.kind", F.lit("paragraph"))).alias("kind"),
        F.when(by_style, F.col("line")).when(by_list, F.concat(F.lit("- "), F.col("line")))
        .when(F.col("found.kind") == "heading", _drop_colons(F.col("line")))
        .otherwise(F.coalesce("found.text", F.col("line"))).alias("text"),
        heading_level.alias("heading_level"),
    )


def empty_documents(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents that gave no block, with the error they end in."""
    return documents.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti").withColumn(
        "error_code", F.lit("EMPTY_DOCUMENT")
    )
