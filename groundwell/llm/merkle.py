"""Merkle manifest of a dataset: levels of aligned blocks as hex strings, parents hashed from fixed-width substrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import parts_for, settle

#: hex digits of a digest, nodes of a run, levels of a block
WIDTH, FAN, DEPTH = 64, 3, 5
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """Lowercase hex sha256 of all fields of a row, with the given text in place of its own."""
    return F.sha2(F.concat(*[encoded(text if name == "text" else F.col(name)) for name in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str], rows_per_part: int = 200_000, least_parts: int = 32) -> DataFrame:
    """rows(grp, ...) with idx, the places 0, 1, ... of the rows of each grp in order of the given columns, and n, the rows of
    the grp; no task sees a whole group. Rows are sorted by range, each range numbers what it holds, and one running sum a
    group over its ranges adds what stands before. rows must be a written table."""
    parts = parts_for(rows.count(), rows_per_part, least_parts)
    ranged = settle(rows.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    held = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("grp", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy("grp")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(offsets, ["grp", "part"]).withColumn("idx", F.col("inside") + F.col("offset")).drop("part", "inside", "offset")


def _digest_at(level: Column, node: Column, count: Column) -> Column:
    """Hex digits of `count` nodes of a level from `node` on; a substring stops at the end of the level."""
    return level.substr((node * WIDTH + 1).cast("int"), (count * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    """The next level of a block: every run of three digests becomes the hash of its hex text."""
    runs = F.ceil(F.length(level) / (WIDTH * FAN)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.sha2(_digest_at(level, r * FAN, F.lit(FAN)), 256)), "")


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """nodes(grp, idx, n, digest, ...) as blocks of 3^5 neighbours: grp, block, n, items (digest and extra columns in order),
    levels (one hex string each, of the block's nodes, their parents and so on). A group that is one block ends at one node; in
    others every block goes up five levels, also a last one with fewer nodes."""
    gathered = (
        nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).groupBy("grp", "block")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", *extra))).alias("items"))
    )
    rises = reduce(lambda so_far, d: F.when(F.col("n") <= FAN**d, d).otherwise(so_far), reversed(range(DEPTH)), F.lit(DEPTH))
    grown = F.aggregate(
        F.array(*map(F.lit, range(1, DEPTH + 1))), F.array(F.array_join(F.transform("items", lambda x: x["digest"]), "")),
        lambda levels, step: F.when(step <= F.col("rises"), F.concat(levels, F.array(_parents(F.element_at(levels, -1))))).otherwise(levels),
    )
    return gathered.withColumn("rises", rises).withColumn("levels", grown)


def _siblings(place: Column) -> Column:
    """For the node at a place of a block, what stands left and right of it in its run, on each level below the last."""
    def flanks(step: Column) -> Column:
        level = F.element_at("levels", step)
        node = F.floor(place / F.pow(F.lit(FAN), step - 1)).cast("int")
        at = F.pmod(node, F.lit(FAN))
        return F.struct(_digest_at(level, node - at, at).alias("left"), _digest_at(level, node + 1, FAN - 1 - at).alias("right"))

    return F.transform(F.filter(F.array(*map(F.lit, range(1, DEPTH + 1))), lambda step: step <= F.col("rises")), flanks)


def _tree(nodes: DataFrame, most: int, extra: list[str], label: str) -> list[DataFrame]:
    """Blocks of all rounds, each written: of the nodes themselves, of the blocks' top nodes, and so on until each group has one
    block. `most` is the number of nodes of the largest group."""
    rounds = []
    while True:
        rounds.append(settle(_blocks(nodes, extra), f"merkle-{label}-{len(rounds)}"))
        if most <= BLOCK:
            return rounds
        nodes = rounds[-1].select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.element_at("levels", -1).alias("digest"))
        most, extra = -(-most // BLOCK), []


def _placed(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the first round with `above`, the siblings from the block's top node up; above(grp, above, ...) has those of
    each group's top node. Rounds are opened from the last to the second, so only their top nodes are multiplied, and rows of a
    group meet what stands above by block and not by group."""
    carried = [c for c in above.columns if c not in ("grp", "above")]
    path = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        opened = F.transform("items", lambda _, place: F.struct((F.col("block") * BLOCK + place).alias("block"), _path(place).alias("above")))
        path = blocks.join(path, ["grp", "block"]).select("grp", *carried, F.inline(opened))
    return rounds[0].join(path, ["grp", "block"])


def _path(place: Column) -> Column:
    return F.concat(_siblings(place), F.col("above"))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """grp and the top digest of each group."""
    return rounds[-1].select("grp", F.element_at("levels", -1).alias("top"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of docs(doc_id, source, lang, n_chars, text): doc_id, leaf, subroot of its source, root,
    proof_sha256 (of all siblings from the leaf to the root), folded_root (from the leaf and the siblings), verified.

    A leaf is the hash of the row's five fields. Leaves of a source stand in order of doc_id, a null doc_id last, rows of one
    doc_id in order of their leaf; equal rows stand side by side, each with its own place. Three neighbours become one node until a
    source has one; the sources' nodes, null first, then bytewise, become the root the same way. A source of one row is its
    leaf; without siblings the proof is the hash of nothing. An empty table gives no rows. Other columns are ignored.
    `tampered` is the text that is hashed for the check in place of the row's own; the rest of the tree stays as it was.

    Texts are hashed where they are read; what is shuffled are digests. A source of any size is spread over blocks of
    243 leaves, and over ranges when leaves are numbered. The driver gets counts and the root.
    """
    changed = tampered if tampered is not None else F.col("text")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("grp"), leaf_hash(F.col("text")).alias("digest"),
        F.when(~changed.eqNullSafe(F.col("text")), leaf_hash(changed)).alias("shown"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("missing", F.col("doc_id").isNull())
    leaves = settle(read, "merkle-leaves")
    most = leaves.groupBy("grp").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    if not most["sources"]:
        return docs.sparkSession.createDataFrame([], RESULT)
    rounds = _tree(numbered(leaves, ["missing", "doc_id", "digest", "row"]), most["most"], ["doc_id", "shown"], "leaves")

    tops = settle(_tops(rounds).select(F.lit(0).alias("grp"), F.col("grp").alias("source"), F.col("top").alias("digest")), "merkle-subroots")
    upper = _tree(numbered(tops, ["source"]), most["sources"], ["source"], "sources")
    root = _tops(upper).first()["top"]
    start = upper[-1].select("grp", F.array().cast("array<struct<left: string, right: string>>").alias("above"))
    of_sources = F.transform("items", lambda item, place: F.struct(item["source"].alias("grp"), _path(place).alias("above"), item["digest"].alias("subroot")))
    above = _placed(upper, start).select(F.inline(of_sources))

    of_rows = F.transform("items", lambda item, place: F.struct(item["doc_id"].alias("doc_id"), item["digest"].alias("leaf"), item["shown"].alias("shown"), _path(place).alias("path")))
    rows = _placed(rounds, above).select("subroot", F.inline(of_rows))
    fold = F.aggregate("path", F.coalesce("shown", "leaf"), lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda side: F.concat(side["left"], side["right"])), ""), 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The text as tampering leaves it: where 2 divides the crc32 of the decimal doc_id, newlines are gone; else it is whole."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


#: DuckDB: the same levels as tables; crc32 is made bit by bit, as its rule says
ORACLE = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
read AS (
    SELECT doc_id, source, text, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head,
        list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
            lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])) % 2 = 1 AS hit
    FROM documents, crc_table),
shown AS (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS tampered FROM read),
leaves AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
        sha256(array_to_string(list_transform(head || [text], lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS leaf,
        sha256(array_to_string(list_transform(head || [tampered], lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS changed
    FROM shown),
lower(level, source, idx, h, n) AS (
    SELECT 0, source, idx, leaf, count(*) OVER (PARTITION BY source) FROM leaves
    UNION ALL
    SELECT level + 1, source, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM lower WHERE n > 1 GROUP BY level, source, idx // 3, n),
tops AS (SELECT source, level AS high, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM lower WHERE n = 1),
upper(level, idx, h, n) AS (
    SELECT 0::BIGINT, place, subroot, count(*) OVER () FROM tops
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, idx // 3, n),
nodes AS (
    SELECT level, source, idx, h, n FROM lower WHERE n > 1
    UNION ALL SELECT high + u.level, t.source, u.idx, u.h, u.n FROM upper u, tops t WHERE u.n > 1),
steps AS (
    SELECT l.doc_id, s.level, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < p.at), '') AS lft, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > p.at), '') AS rgt
    FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN nodes s ON s.source IS NOT DISTINCT FROM l.source,
        LATERAL (SELECT CASE WHEN s.level < t.high THEN l.idx // (3 ** s.level)::BIGINT ELSE t.place // (3 ** (s.level - t.high))::BIGINT END AS at) p
    WHERE s.idx // 3 = p.at // 3 GROUP BY l.doc_id, s.level),
proofs AS (SELECT doc_id, list(lft ORDER BY level) AS lefts, list(rgt ORDER BY level) AS rights, string_agg(lft || rgt, '' ORDER BY level) AS proof FROM steps GROUP BY doc_id),
done AS (
    SELECT l.doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce([changed] || range(1, len(coalesce(lefts, [])) + 1)::VARCHAR[], lambda h, i: sha256(lefts[i::INT] || h || rights[i::INT])) AS folded_root
    FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source LEFT JOIN proofs USING (doc_id))
SELECT *, folded_root = root AS verified FROM done
"""
