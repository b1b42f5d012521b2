"""Near duplicates: BagMinHash signatures of shingle multisets, banding, and a check of every candidate pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import MIX, bounded_batches, hash_words, keep_rows, mixed, settle, slices, tidied, utf8

SHINGLE = 5


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and the text of each. A text of fewer than five words is one shingle, one without words none."""
    words, first = hash_words(data, offsets)
    sizes = np.diff(first)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text]
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < first[1:][text]
        step = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(there, (out + step) * MIX + np.uint64(k + 1), out)
    return mixed(out), text


def multisets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    key = hashes ^ mixed(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(begins)
    return hashes[order[at]], text[order[at]], np.diff(np.append(at, len(key)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(element: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts, size) of weighted sets; equal components have the weighted Jaccard similarity as probability.

    Each element has Poisson processes over the weight intervals [0,1), [1,2), [2,4), [4,8), ...: points in time with a
    component and a level. An element of weight w has the points of level below w, so two texts share exactly the points
    below the smaller weight. A component keeps its earliest point. Points are made in the order of time and only up to
    the time by which all components are likely to be met; texts where one is still open go on to twice that time.
    A text without elements has infinite components.
    """
    out = np.full((texts, size), np.inf)
    total = np.bincount(text, weight, texts)
    todo, budget = total > 0, size * (np.log(size) + 3.0)
    while todo.any():
        limit = np.where(todo, budget / np.maximum(total, 1e-300), -1.0)
        here = np.flatnonzero(todo[text])
        out[todo] = np.inf
        flat = out.reshape(-1)
        low, high, level = 0.0, 1.0, 0
        while len(here):  # one interval of weights after the other, for the elements that reach it
            seed = mixed(element[here] * MIX + np.uint64(2 * level + 1))
            owner, top = text[here], weight[here]
            time, step = np.zeros(len(here)), 0
            while len(seed):
                step += 1
                draw = mixed(seed + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
                time = time - np.log(_uniform(draw)) / (high - low)
                on = time <= limit[owner]
                seed, owner, top, time, draw = seed[on], owner[on], top[on], time[on], draw[on]
                more = mixed(draw ^ np.uint64(0x8CB92BA72F3D8DD7))
                place = owner * size + ((more >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
                if high - low > 1:
                    counts = low + (high - low) * _uniform(mixed(more)) < top
                    np.minimum.at(flat, place[counts], time[counts])
                else:
                    np.minimum.at(flat, place, time)
            here = here[weight[here] > high]
            low, high, level = high, 2 * high, level + 1
        todo &= np.isinf(out).any(1)
        budget *= 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` components."""
    bits = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * MIX + bits[:, :, r])
    return key


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                data, at = utf8(batch.column(1))
                element, text, weight = multisets(*shingles(data, at))
                signatures = bag_minhash(element, text, weight.astype(float), batch.num_rows, bands * rows)
                keys, some = band_keys(signatures, rows).view(np.int64), np.isfinite(signatures[:, 0])
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array([k.tolist() if s else [] for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64()))],
                    ["doc_id", "node", "bands"],
                )

    return run


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of two texts, row by row; 0 where neither has words."""
    sides = []
    for column in (left, right):
        hashes, text = shingles(*utf8(column))
        element, owner, count = multisets(hashes, text)
        sides.append((element ^ mixed(owner.astype(np.uint64) + np.uint64(7)), owner, count, np.bincount(text, minlength=len(column))))
    (ka, owner, ca, na), (kb, _, cb, nb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(owner[ia], np.minimum(ca[ia], cb[ib]), len(na))
    return both / np.maximum(na + nb - both, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similarity = overlap(batch.column(2), batch.column(3)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity, pa.float64())], ["a", "b", "similarity"])


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) with the similarity of their texts(node, text)."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidied(_verify), "a binary, b binary, similarity double")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            element, text, count = multisets(*shingles(*utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(element.view(np.int64)), pa.array(count, pa.int64())], ["node", "shingle", "n"])


def shingle_counts(texts: DataFrame) -> DataFrame:
    """node, shingle, n of texts(node, text), written."""
    return settle(texts.select("node", "text").mapInArrow(tidied(_counted), "node binary, shingle long, n long"), "minhash-shingles")


def shared_sizes(counted: DataFrame) -> DataFrame:
    """Of counted(node, shingle, n): node, size (shingles), shared (those that some other of these nodes has too).

    No node of the table overlaps another one in more than the smaller `shared` of the two.
    """
    alone = counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node"), F.sum("n").alias("n")).filter("texts = 1").groupBy("node").agg(F.sum("n").alias("alone"))
    sizes = counted.groupBy("node").agg(F.sum("n").alias("size"))
    return sizes.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def differing_pairs(nodes: DataFrame, counted: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes(node, root, cluster) to compare, given counted(node, shingle, n): links among them join the same
    nodes as all links of at least `similarity` between nodes of one cluster and of different roots would.

    Each cluster has a base, the shingle occurrences that more than half of its nodes have, and each node its marks: what it
    lacks of the base and what it has beyond it. Two nodes overlap in |base| - lacks - lacks + common marks, so the pair is a
    link if and only if it has at least need + need common marks, where need = s / (1 + s) * size + lacks - |base| / 2.
    Where the needs are 0 or less together, both are links of the node of least need. All others have a common mark, and
    their first one in the order of frequency lies so early in both that enough marks follow. Marks of one node count
    for nothing. So near copies that differ from each other in edits of their own make no pairs, however many they are.
    """
    share, none = similarity / (1 + similarity), F.array().cast("array<long>")
    elements = (
        counted.join(nodes.select("node", "cluster"), "node").select("cluster", "node", "shingle", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
        .select("cluster", "node", F.xxhash64("shingle", "i").alias("element"))
    )
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"))
    held = elements.groupBy("cluster", "element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    base = held.join(sizes, "cluster").filter("2 * n > nodes").groupBy("cluster").agg(F.collect_list("element").alias("base"))
    own = elements.groupBy("node").agg(F.collect_list("element").alias("own"))
    both = nodes.join(own, "node").join(base, "cluster", "left").withColumn("base", F.coalesce("base", none)).withColumn("lacks", F.array_except("base", "own"))
    need = F.size("own") * share + F.size("lacks") - F.size("base") / 2
    marked = settle(both.select("cluster", "node", "root", need.alias("need"), F.concat("lacks", F.array_except("own", "base")).alias("marks")), "minhash-marks")
    least = marked.groupBy("cluster").agg(F.min(F.struct("need", "node", "root")).alias("least"))
    marked = marked.join(least, "cluster").withColumn("sure", F.expr("need + least.need <= 1e-9"))
    stars = marked.filter("sure AND root != least.root").select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))

    rows = marked.select("cluster", "node", F.when(F.col("sure"), F.col("least.root")).otherwise(F.col("root")).alias("root"), "need", F.col("least.need").alias("low"), F.explode("marks").alias("mark"))
    common = rows.groupBy("cluster", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    order = Window.partitionBy("node").orderBy("n", "mark").rowsBetween(0, Window.unboundedFollowing)
    placed = rows.join(common, ["cluster", "mark"]).withColumn("rest", F.count(F.lit(1)).over(order))  # marks from this one on
    placed = settle(placed.filter("rest >= need + low - 1e-9").drop("n"), "minhash-placed")
    meet = (
        "one.cluster = two.cluster AND one.mark = two.mark AND one.root != two.root AND struct(one.need, one.node) < struct(two.need, two.node) "
        "AND least(one.rest, two.rest) >= one.need + two.need - 1e-9"
    )
    near = placed.alias("one").join(placed.alias("two"), F.expr(meet)).select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
    return stars.unionByName(near).distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable over links(a, b), for every node that has one: (node, root). Alternating stars, written each round."""
    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-edges")
    before = mark(edges)
    while before[0]:
        # large star: each neighbour above u goes to the smallest neighbour of u (or u); small star: each node's smaller ones likewise
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        done = settle(small, "cc-edges")
        edges, now = done, mark(done)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links so far: roots stand for the earlier ones."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b").unionByName(links))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 32, rows: int = 5, rounds: int = 4) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id, class_size (rows), text_class, node (names the text).

    Two texts are linked when the multisets of their five-word shingles (words split at ASCII white space, A-Z as a-z)
    have a weighted Jaccard similarity of at least `similarity`; equal texts always are. Classes are the connected
    components; class_id is their smallest doc_id (null where all are null), text_class names the component. A null text is
    empty. Texts without words are only linked to equal ones. Other columns are ignored.

    With 32 bands of 5 components a pair at 0.8 is missed as a candidate with probability 3e-6. Candidates are checked on
    the whole texts. A bucket of any size costs a pair per member and round: members are compared with one leader, and
    only members of other components than the leader go on to the next. What is left after the rounds is joined on
    what sets each text apart from the others of its buckets (differing_pairs), which loses no link.
    """
    bounded_batches(docs.sparkSession)
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = settle(texts_of.mapInArrow(tidied(_sign(bands, rows)), "doc_id long, node binary, bands array<long>"), "minhash-signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    owners = signed.join(nodes.select("node", F.col("doc_id").alias("first")), "node").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", F.explode("bands").alias("key")).distinct()
    buckets = owners.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a")
    members = settle(owners.join(buckets, "key").select("key", "a", F.col("node").alias("b")), "minhash-members")

    pairs = settle(members.filter("a != b").select("a", "b").distinct(), "minhash-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", "doc_id")
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    named = texts_of.withColumn("node", digest).withColumn("known", F.coalesce("doc_id", F.lit(-1)))
    wanted = wanted.select("node", F.coalesce("doc_id", F.lit(-1)).alias("known"))
    texts = settle(named.join(wanted, ["node", "known"]).select("node", "text").dropDuplicates(["node"]), "minhash-texts")

    compared = settle(checked(pairs, texts), "minhash-checked")
    links = compared.filter(F.col("similarity") >= similarity).select("a", "b")
    roots = components(links)

    def across(rows: DataFrame, step: int) -> DataFrame:
        """Members of buckets that still hold several components, with their component, and a leader drawn from the largest."""
        rooted = rows.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
        parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("b", F.xxhash64("b", F.lit(step))).alias("leader"))
        several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root", "leader")).alias("top")).filter("parts > 1")
        return rooted.join(several.select("key", F.col("top.root").alias("top"), F.col("top.leader").alias("leader")), "key")

    # from here on only nodes of such buckets that share enough with any other of them
    far = across(members, 0)
    counted = shingle_counts(texts.join(far.select(F.col("b").alias("node")).distinct(), "node", "left_semi"))
    sized = shared_sizes(counted).filter(F.col("shared") >= similarity * F.col("size")).select(F.col("node").alias("b"))
    members = settle(far.select("key", "a", "b").join(sized, "b"), "minhash-members")
    for step in range(1, rounds):
        more = across(members, step).filter("root != top").select(F.least("b", "leader").alias("a"), F.greatest("b", "leader").alias("b")).distinct()
        fresh = settle(checked(more.join(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), texts), "minhash-checked")
        roots = joined(roots, fresh.filter(F.col("similarity") >= similarity).select("a", "b"))
    left = settle(across(members, 0).select("a", "b", "root"), "minhash-left")
    clusters = components(left.select("a", "b")).select(F.col("node").alias("b"), F.col("root").alias("cluster"))
    left = left.select("b", "root").distinct().join(clusters, "b", "left").select(F.col("b").alias("node"), "root", F.coalesce("cluster", "b").alias("cluster"))
    rest = differing_pairs(left, counted, similarity).join(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    fresh = settle(checked(rest, texts), "minhash-checked").filter(F.col("similarity") >= similarity).select("a", "b")
    roots = joined(roots, fresh)

    classed = nodes.join(roots, "node", "left").select("node", "doc_id", "copies", F.coalesce("root", "node").alias("text_class"))
    classes = classed.groupBy("text_class").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = settle(classed.join(classes, "text_class").select("node", "class_id", "class_size", "text_class"), "minhash-classes")
    return signed.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size", F.hex("text_class").alias("text_class"), F.hex("node").alias("node"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """Rows of docs that stay: of each class the row of smallest doc_id (null last), once; all columns, unchanged."""
    first = near_duplicates(docs).groupBy("text_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"))
    node = F.upper(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))

    def key(doc_id: Column, node: Column) -> Column:
        return F.concat_ws(":", node, doc_id.cast("long"))

    return keep_rows(docs, key(F.col("doc_id"), node), first.select(key(F.col("first.doc_id"), F.col("first.node")).alias("keep")), once=True)
