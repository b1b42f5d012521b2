"""Section-aware chunks from normalized blocks.

Only the three greedy packings are folds; they run over the integers of one document (token counts and
flags) inside the JVM. Sections, heading paths and question pairing are running windows. All of it keeps
the by-document partitioning of the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T

MAX_LEVEL = 6
STRUCTURED_KINDS = ["list_item", "table_row", "qa_pair"]


def token_count(text: Column) -> Column:
    """One token per four characters, rounded up; 0 for no text."""
    length = F.length(text)
    return F.when(length == 0, 0).otherwise(F.ceil(length / 4)).cast("int")


def section_minimum(target: int) -> int:
    return max(20, min(100, target // 4))


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Body blocks with section_no, section_title, heading_level and section_path.

    The heading stack is popped while it is at least as long as the new level, so its length after a heading
    is `min(length before, level - 1) + 1`. Unrolled over a document that is a running minimum, and the entry
    at a depth is the last heading that was pushed at that depth.
    """
    order = Window.partitionBy("doc_id").orderBy("block_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("kind") == "heading"
    level = F.coalesce(F.when(F.col("heading_level") > 0, F.least("heading_level", F.lit(MAX_LEVEL))), F.lit(1))
    rows = blocks.withColumn("block_index", F.row_number().over(order) - 1)
    rows = rows.withColumn("section_no", F.sum(is_heading.cast("int")).over(so_far)).withColumn(
        "level", F.when(is_heading, level)
    )
    slack = F.min(F.col("level") - F.col("section_no")).over(so_far)
    rows = rows.withColumn(
        "depth", F.when(is_heading, F.col("section_no") + F.least(F.lit(0), slack))
    )
    at_depth = [
        F.last(F.when(F.col("depth") == d, F.col("text")), ignorenulls=True).over(so_far)
        for d in range(1, MAX_LEVEL + 1)
    ]
    rows = rows.select(
        "*",
        F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(so_far).alias("section_title"),
        F.last("level", ignorenulls=True).over(so_far).alias("section_level"),
        F.slice(F.array(*at_depth), F.lit(1), F.coalesce(F.last("depth", ignorenulls=True).over(so_far), F.lit(0)))
        .alias("section_path"),
    )
    return rows.filter(F.col("kind") != "heading").drop("level", "depth", "heading_level").withColumnRenamed(
        "section_level", "heading_level"
    )


def merge_small_sections(sizes: str, target: int = V.CHUNK_TARGET_TOKENS) -> Column:
    """Group number (from 1) of every section, from the array column of a document's section sizes in order.

    A group below the minimum takes in the next section while both fit the target; a lone small section that
    could not grow joins the group before it when that fits.
    """
    low = section_minimum(target)
    close = f"""CASE
        WHEN s.n = 1 AND s.tokens < {low} AND s.gid > 0 AND s.before + s.tokens <= {target}
        THEN named_struct('groups', concat(s.groups, array_repeat(s.gid, s.n)), 'gid', s.gid,
                          'before', s.before + s.tokens, 'tokens', 0, 'n', 0)
        WHEN s.n > 0
        THEN named_struct('groups', concat(s.groups, array_repeat(s.gid + 1, s.n)), 'gid', s.gid + 1,
                          'before', s.tokens, 'tokens', 0, 'n', 0)
        ELSE s END"""
    step = f"""CASE
        WHEN s.n > 0 AND s.tokens < {low} AND s.tokens + t <= {target}
        THEN named_struct('groups', s.groups, 'gid', s.gid, 'before', s.before, 'tokens', s.tokens + t, 'n', s.n + 1)
        ELSE transform(array({close}), c -> named_struct('groups', c.groups, 'gid', c.gid, 'before', c.before,
                                                         'tokens', t, 'n', 1))[0] END"""
    start = "named_struct('groups', cast(array() as array<int>), 'gid', 0, 'before', 0, 'tokens', 0, 'n', 0)"
    return F.expr(f"aggregate({sizes}, {start}, (s, t) -> {step}, s -> ({close}).groups)")


def pair_questions(rows: DataFrame) -> DataFrame:
    """Add unit_no within a section: a question and the answers after it share one, other blocks stand alone."""
    order = Window.partitionBy("doc_id", "section_no").orderBy("block_index")
    is_qa = F.col("kind") == "qa_pair"
    follows = F.coalesce(F.lag("kind").over(order) == "qa_pair", F.lit(False))
    next_question = F.coalesce(
        (F.col("qa_label") == "Q") & (F.lag("qa_label").over(order) == "A"), F.lit(False)
    )
    starts = ~(is_qa & follows & ~next_question)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("starts", starts).withColumn("unit_no", F.sum(F.col("starts").cast("int")).over(so_far)) \
        .drop("starts")


def text_parts(text: Column, kind: Column) -> Column:
    """Parts of a text too large for one unit: questions or lines by kind, else paragraphs, sentences, lines,
    words; the first split that gives more than one part."""
    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), T.strip), lambda p: p != "")

    by_kind = F.when(kind == "qa_pair", parts(r"\n(?=Q:)")).when(kind.isin("list_item", "table_row"), parts(r"\n"))
    choices = [by_kind, parts(r"\n{2,}"), parts(r"(?U)(?<=[.!?])\s+"), parts(r"\R")]
    picked = F.when(F.size(choices[0]) > 1, choices[0])
    for choice in choices[1:]:
        picked = picked.when(F.size(choice) > 1, choice)
    return picked.otherwise(parts(r"(?U)\s+"))


def pack_parts(parts: str, limit: str) -> Column:
    """Greedy packing of an array column of parts into texts of at most `limit` (a column) tokens; a single
    part above the limit stays whole."""
    size = "CAST(ceil(length(t) / 4) AS INT)"
    step = f"""CASE WHEN s.cur IS NOT NULL AND s.tok + {size} > {limit}
        THEN named_struct('done', concat(s.done, array(s.cur)), 'cur', t, 'tok', {size})
        ELSE named_struct('done', s.done, 'cur', concat_ws(' ', s.cur, t), 'tok', s.tok + {size}) END"""
    start = "named_struct('done', cast(array() as array<string>), 'cur', cast(null as string), 'tok', 0)"
    return F.expr(
        f"aggregate({parts}, {start}, (s, t) -> {step}, s -> filter(concat(s.done, array(s.cur)), x -> x <> ''))"
    )


def split_large_units(units: DataFrame, target: int = V.CHUNK_TARGET_TOKENS) -> DataFrame:
    """One row per piece of a unit; a section's title takes its share of the target."""
    title_tokens = F.coalesce(token_count(F.col("section_title")), F.lit(0))
    room = F.when(F.coalesce(F.col("section_title"), F.lit("")) != "", F.greatest(F.lit(1), target - title_tokens))
    staged = units.withColumn("room", F.coalesce(room, F.lit(target)))
    fits = token_count(F.col("text")) <= F.col("room")
    staged = staged.withColumn("parts", F.when(~fits, text_parts(F.col("text"), F.col("kind"))))
    pieces = F.when(fits, F.array("text")).otherwise(pack_parts("parts", "room"))
    rows = staged.filter("text <> ''").withColumn("pieces", pieces)
    keep = [c for c in units.columns if c != "text"]
    return rows.select(*keep, F.posexplode("pieces").alias("piece_no", "text")).withColumn(
        "tokens", token_count(F.col("text"))
    )


def group_units(units: str, limit: str, overlap: int = V.CHUNK_OVERLAP_TOKENS) -> Column:
    """Unit indexes of every chunk, from an array column of struct(i, tokens, heading).

    A chunk is closed when the next unit does not fit `limit` (a column). The next one starts with the nearest
    non-heading units of the closed one: taken while fewer than `overlap` tokens are carried, and only as long
    as the carried units and the waiting unit fit.
    """
    item = "struct<i:int,tokens:int,heading:boolean>"
    carry = f"""aggregate(reverse(filter(s.cur, x -> NOT x.heading)),
        named_struct('kept', cast(array() as array<{item}>), 'tok', 0, 'open', true),
        (o, x) -> CASE WHEN o.open AND (size(o.kept) = 0 OR o.tok < {overlap}) AND o.tok + x.tokens + t.tokens <= {limit}
            THEN named_struct('kept', concat(o.kept, array(x)), 'tok', o.tok + x.tokens, 'open', true)
            ELSE named_struct('kept', o.kept, 'tok', o.tok, 'open', false) END)"""
    step = f"""CASE WHEN size(s.cur) = 0 OR s.tok + t.tokens <= {limit}
        THEN named_struct('done', s.done, 'cur', concat(s.cur, array(t)), 'tok', s.tok + t.tokens)
        ELSE transform(array({carry}), o -> named_struct(
            'done', concat(s.done, array(transform(s.cur, x -> x.i))),
            'cur', concat(reverse(o.kept), array(t)), 'tok', o.tok + t.tokens))[0] END"""
    start = f"""named_struct('done', cast(array() as array<array<int>>), 'cur', cast(array() as array<{item}>), 'tok', 0)"""
    finish = "CASE WHEN size(s.cur) > 0 THEN concat(s.done, array(transform(s.cur, x -> x.i))) ELSE s.done END"
    return F.expr(f"aggregate({units}, {start}, (s, t) -> {step}, s -> {finish})")


_UNIT = ["section_rank", "unit_no", "piece_no", "text", "tokens", "kind", "pages", "block_start", "block_end",
         "section_title", "section_path"]


def build_units(blocks: DataFrame, target: int = V.CHUNK_TARGET_TOKENS) -> DataFrame:
    """Units of every section: single blocks, question-and-answer runs, and pieces of blocks that are too large."""
    sections = assign_sections(blocks)
    in_section = Window.partitionBy("doc_id", "section_no")
    title_tokens = F.when(
        F.coalesce("section_title", F.lit("")) != "", token_count(F.col("section_title"))
    ).otherwise(0)
    sized = sections.withColumn(
        "section_tokens", (F.sum(token_count(F.col("text"))).over(in_section) + title_tokens).cast("int")
    ).withColumn("section_rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("section_no")))
    runs = pair_questions(sized).groupBy("doc_id", "section_no", "section_rank", "unit_no").agg(
        F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("texts"),
        F.first("kind").alias("kind"),
        F.array_sort(F.collect_set("page_number")).alias("pages"),
        F.min("block_index").alias("block_start"), F.max("block_index").alias("block_end"),
        F.first("section_title").alias("section_title"), F.first("section_path").alias("section_path"),
        F.first("section_tokens").alias("section_tokens"),
    )
    text = F.array_join(F.filter(F.transform("texts", lambda x: T.strip(x["text"])), lambda x: x != ""), "\n")
    return split_large_units(runs.withColumn("text", text).drop("texts"), target)


def section_groups(units: DataFrame, target: int = V.CHUNK_TARGET_TOKENS) -> DataFrame:
    """Add group_no, the merged section group of a unit."""
    per_doc = units.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*_UNIT, "section_tokens"))).alias("units")
    )
    sizes = F.transform(
        F.array_distinct(F.transform("units", lambda u: F.struct(u["section_rank"], u["section_tokens"].alias("n")))),
        lambda x: x["n"],
    )
    grouped = per_doc.withColumn("sizes", sizes).withColumn("groups", merge_small_sections("sizes", target))
    placed = F.transform(
        "units", lambda u: F.struct(F.get("groups", u["section_rank"] - 1).alias("group_no"), u.alias("unit"))
    )
    return grouped.select("doc_id", F.inline(placed)).select("doc_id", "group_no", "unit.*")


def chunk_documents(
    blocks: DataFrame, target: int = V.CHUNK_TARGET_TOKENS, overlap: int = V.CHUNK_OVERLAP_TOKENS,
    version: str = V.CHUNK_VERSION,
) -> DataFrame:
    """Chunks of every document with text, tokens, section, pages, metadata and checksum."""
    units = section_groups(build_units(blocks, target), target)
    grouped = units.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct(*_UNIT))).alias("units"))
    sections = F.array_distinct(F.transform("units", lambda u: F.struct(
        u["section_rank"].alias("section_rank"), u["section_title"].alias("section_title"),
        u["section_path"].alias("section_path"))))
    grouped = grouped.withColumn("sections", sections).withColumn("merged", F.size("sections") > 1)
    grouped = grouped.withColumn("title", F.when(~F.col("merged"), F.nullif(F.col("units")[0]["section_title"], F.lit(""))))

    def section_heading(s: Column) -> Column:
        inside = F.filter("units", lambda u: u["section_rank"] == s["section_rank"])
        return _heading(
            s["section_rank"], s["section_title"], s["section_path"],
            F.array_sort(F.array_distinct(F.flatten(F.transform(inside, lambda u: u["pages"])))),
            F.array_min(F.transform(inside, lambda u: u["block_start"])),
            F.array_max(F.transform(inside, lambda u: u["block_end"])),
        )

    titled = F.filter("sections", lambda s: F.coalesce(s["section_title"], F.lit("")) != "")
    all_units = F.when(
        F.col("merged"), F.array_sort(F.concat("units", F.transform(titled, section_heading)))
    ).otherwise(F.col("units"))
    limit = F.greatest(F.lit(1), target - F.coalesce(token_count(F.col("title")), F.lit(0)))
    packed = grouped.withColumn("units", all_units).withColumn("chunk_limit", limit).withColumn(
        "sizes", F.transform("units", lambda u, i: F.struct(
            i.alias("i"), u["tokens"].alias("tokens"), (u["kind"] == "heading").alias("heading")))
    ).withColumn("picked", group_units("sizes", "chunk_limit", overlap))
    chunked = F.transform("picked", lambda ids: F.transform(ids, lambda i: F.get("units", i)))
    rows = packed.select("doc_id", "group_no", "title", F.posexplode(chunked).alias("part_no", "units"))
    first = F.col("units")[0]
    sticky = _heading(
        first["section_rank"], F.col("title"), first["section_path"], first["pages"], first["block_start"],
        first["block_start"],
    )
    needs_title = F.col("title").isNotNull() & (first["text"] != F.col("title"))
    rows = rows.withColumn("units", F.when(needs_title, F.concat(F.array(sticky), "units")).otherwise(F.col("units")))
    order = Window.partitionBy("doc_id").orderBy("group_no", "part_no")
    return assemble(rows.withColumn("chunk_no", F.row_number().over(order)), version)


def _heading(rank: Column, title: Column, path: Column, pages: Column, start: Column, end: Column) -> Column:
    """A heading as a unit; it sorts before the units of its section."""
    return F.struct(
        rank.alias("section_rank"), F.lit(-1).alias("unit_no"), F.lit(0).alias("piece_no"), title.alias("text"),
        token_count(title).alias("tokens"), F.lit("heading").alias("kind"), pages.alias("pages"),
        start.alias("block_start"), end.alias("block_end"), title.alias("section_title"), path.alias("section_path"),
    )


def assemble(rows: DataFrame, version: str = V.CHUNK_VERSION) -> DataFrame:
    """Text, counts, section, pages, metadata and checksum of chunks given as arrays of units."""
    def each(field: str) -> Column:
        return F.transform("units", lambda u: u[field])

    titles = F.array_distinct(F.filter(each("section_title"), lambda t: F.coalesce(t, F.lit("")) != ""))
    paths = F.array_distinct(F.filter(each("section_path"), lambda p: F.size(p) > 0))
    staged = rows.select(
        "doc_id", "chunk_no",
        T.strip(F.array_join(F.filter(each("text"), lambda t: t != ""), "\n\n")).alias("content"),
        F.array_sort(F.array_distinct(F.flatten(each("pages")))).alias("page_numbers"),
        titles.alias("section_titles"), paths.alias("section_paths"),
        F.array_sort(F.array_distinct(each("kind"))).alias("block_kinds"),
        F.array_min(each("block_start")).alias("source_block_start"),
        F.array_max(each("block_end")).alias("source_block_end"), F.size("units").alias("unit_count"),
    )
    structured = F.arrays_overlap("block_kinds", T.strings(STRUCTURED_KINDS))
    checksum = F.sha2(
        F.concat_ws("|", "content", F.array_join("section_titles", ","),
                    F.array_join(F.col("page_numbers").cast("array<string>"), ","), F.lit(version)), 256)
    return staged.select(
        "*", T.search_text(F.col("content")).alias("search_text"), token_count(F.col("content")).alias("token_count"),
        F.get("section_titles", F.lit(0)).alias("section_title"), F.get("page_numbers", F.lit(0)).alias("page_number"),
        F.when(F.size("section_paths") == 1, F.get("section_paths", F.lit(0))).alias("section_path"),
        F.array_min("page_numbers").alias("page_start"), F.array_max("page_numbers").alias("page_end"),
        structured.alias("contains_structured_content"), checksum.alias("checksum"),
        F.lit(V.CHUNK_STRATEGY).alias("chunking_strategy"), F.lit(version).alias("chunking_version"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.round(F.avg("token_count"), 2).alias("average_tokens")
    )


def embed_batches(
    chunks: DataFrame, max_items: int = V.EMBED_BATCH_ITEMS, max_tokens: int = V.EMBED_BATCH_TOKENS
) -> DataFrame:
    """Add batch_no and batch_pos: neighbouring chunks of a document packed into provider-sized batches."""
    listed = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "token_count"))).alias("items")
    )
    step = f"""CASE WHEN s.n > 0 AND (s.n >= {max_items} OR s.tok + t.token_count > {max_tokens})
        THEN named_struct('out', concat(s.out, array(named_struct('b', s.b + 1, 'p', 0))), 'b', s.b + 1, 'n', 1, 'tok', t.token_count)
        ELSE named_struct('out', concat(s.out, array(named_struct('b', s.b, 'p', s.n))), 'b', s.b, 'n', s.n + 1, 'tok', s.tok + t.token_count) END"""
    start = "named_struct('out', cast(array() as array<struct<b:int,p:int>>), 'b', 0, 'n', 0, 'tok', 0)"
    placed = listed.withColumn("spots", F.expr(f"aggregate(items, {start}, (s, t) -> {step}, s -> s.out)"))
    rows = placed.select("doc_id", F.inline(F.arrays_zip("items", "spots"))).select(
        "doc_id", "items.chunk_no", F.col("spots.b").alias("batch_no"), F.col("spots.p").alias("batch_pos")
    )
    return chunks.join(rows, ["doc_id", "chunk_no"])


def attach_embeddings(batched: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """Zip provider results (doc_id, batch_no, embeddings) to chunks.

    A batch that came back short is rejected whole, an empty vector rejects its chunk; both keep an
    `embedding_error` instead of failing the job.
    """
    sent = batched.groupBy("doc_id", "batch_no").agg(F.count("*").alias("sent"))
    checked = sent.join(results, ["doc_id", "batch_no"], "left").withColumn(
        "complete", F.coalesce(F.size("embeddings") == F.col("sent"), F.lit(False))
    )
    vectors = checked.select("doc_id", "batch_no", "complete", F.posexplode_outer("embeddings").alias("batch_pos", "vector"))
    whole = checked.select("doc_id", "batch_no", "complete")
    matched = batched.join(whole, ["doc_id", "batch_no"], "left").join(
        vectors.filter("complete").select("doc_id", "batch_no", "batch_pos", "vector"),
        ["doc_id", "batch_no", "batch_pos"], "left",
    )
    good = F.col("complete") & (F.size("vector") > 0)
    error = F.when(~F.coalesce("complete", F.lit(False)), "OPENAI_EMBEDDING_FAILED").when(
        F.coalesce(F.size("vector"), F.lit(0)) <= 0, "OPENAI_RESPONSE_EMPTY")
    return matched.select(
        *batched.columns, F.when(good, F.col("vector")).alias("embedding"),
        F.when(good, F.lit(model)).alias("embedding_model"), F.when(good, F.size("vector")).alias("embedding_dim"),
        error.alias("embedding_error"),
    )
