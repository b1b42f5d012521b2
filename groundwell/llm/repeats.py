"""Repeated passages: bytes of every 50-byte string that an earlier document has too, by sparse suffix sorting and induction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import MIX, _powers, bounded_batches, mixed, settle, tidied, utf8

LENGTH = 50
GRAM = 28
#: an anchor lies at most so far behind the beginning of a string
REACH = LENGTH - GRAM
LAST = 2**63 - 1
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, gram hash and the first and last string of each anchor.

    The anchor of a string is the place of its 28-byte gram of smallest hash (the first of equals). It depends on the
    string alone, so equal strings have the same gram at the same distance. Strings with one anchor are neighbours.
    """
    sizes = np.diff(offsets)
    count = len(data) - LENGTH + 1
    if count <= 0 or (sizes >= LENGTH).sum() == 0:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, _powers(len(data), int(MIX)), out=sums[1:])
    np.cumsum(sums, out=sums)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _powers(len(data) + 1, pow(int(MIX), -1, 1 << 64))[: len(sums) - GRAM])
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    key = np.minimum(key[: count], key[REACH + 1 - 16 : REACH + 1 - 16 + count])  # smallest of 23 grams
    whole = np.zeros(len(data) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:count]) > 0)  # strings inside one text
    place = (key[at] & _PLACE).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    low, high, place = at[first], at[np.r_[first[1:], len(at)] - 1], place[first]
    return np.searchsorted(offsets, low, "right") - 1, place, grams[place], low, high


def _slices(batch: pa.RecordBatch, column: int):
    """Parts of about 256 KB, whose arrays stay in the processor's cache, or one text; places fit 24 bits for texts of up to 16 MB,
    longer ones are cut with an overlap."""
    begun, (_, offsets) = 0, utf8(batch.column(column))
    while begun < batch.num_rows:
        end = max(begun + 1, int(np.searchsorted(offsets, offsets[begun] + (1 << 18), "right")) - 1)
        yield begun, batch.slice(begun, end - begun)
        begun = end


def _anchors_of(column: pa.Array):
    """anchors() of a column with places in the column's bytes; a text of over 8 MB goes through in overlapping parts."""
    data, offsets = utf8(column)
    if len(data) < 1 << 23:
        return data, offsets, anchors(data, offsets)
    out = []
    for t in range(len(offsets) - 1):
        for begin in range(int(offsets[t]), max(int(offsets[t + 1]) - LENGTH + 1, int(offsets[t]) + 1), 1 << 22):
            end = min(begin + (1 << 22) + LENGTH - 1, int(offsets[t + 1]))
            _, place, gram, low, high = anchors(data[begin:end], np.array([0, end - begin]))
            out.append((np.full(len(place), t), place + begin, gram, low + begin, high + begin))
    return data, offsets, tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _place_of(gram: np.ndarray, bits: int) -> np.ndarray:
    """Place of a gram in the filter. Anchors have the smallest hashes of their strings, so these are mixed again: as they are, they
    would crowd the first places, and most grams would share one."""
    return mixed(gram ^ MIX) >> np.uint64(64 - bits)


def _coded(code: np.ndarray) -> bytes:
    """Ascending codes as steps of two bytes, or as they are (four bytes) if a step is larger; the first byte tells which."""
    steps = np.diff(code, prepend=code[:1])
    if len(code) and steps.max() < 1 << 16:
        return b"\2" + code[:1].astype("<u4").tobytes() + steps[1:].astype("<u2").tobytes()
    return b"\4" + code.astype("<u4").tobytes()


def _decoded(content: bytes) -> np.ndarray:
    if content[:1] == b"\4":
        return np.frombuffer(content, "<u4", offset=1)
    return np.cumsum(np.r_[np.frombuffer(content, "<u4", 1, 1), np.frombuffer(content, "<u2", offset=5)].astype(np.int64))


def _grams(bits: int, parts: int):
    """Gram bits of a batch by part of the filter: each once, with a mark if two documents of the batch have it."""
    width = bits - int(np.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            pairs = []
            for begun, batch in _slices(whole, 1):
                text, _, gram, _, _ = _anchors_of(batch.column(1))[2]
                pairs.append(np.unique(_place_of(gram, bits) << np.uint64(24) | (text + begun).astype(np.uint64)))
            bit = np.sort(np.concatenate(pairs) >> np.uint64(24)) if pairs else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.r_[True, bit[1:] != bit[:-1]]) if len(bit) else np.zeros(0, np.int64)
            twice = np.diff(np.append(first, len(bit))) > 1
            bit = bit[first]
            code = ((bit & np.uint64((1 << width) - 1)) << np.uint64(1) | twice.astype(np.uint64)).astype(np.int64)
            cuts = np.searchsorted(bit >> np.uint64(width), np.arange(parts + 1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([_coded(code[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["part", "codes"])

    return run


def _filter_parts(width: int):
    """Sorted rows (part, codes) to the part's bits: set for a gram of two batches, or of two documents of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, more = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for p, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, once, more = p, np.zeros(1 << width, bool), np.zeros(1 << width, bool)
                code = _decoded(codes)
                at = code >> 1
                more[at] |= once[at] | (code & 1).astype(bool)
                once[at] = True
        if part is not None:
            yield row()

    return run


def shared_grams(rows: DataFrame, bits: int, parts: int = 64) -> bytes:
    """A bitmap of 2^bits places with all grams that two documents share (and a few others), compressed: each executor stores a copy.
    Its size does not grow with the table beyond that of the bitmap."""
    width = bits - int(np.log2(parts))
    found = (
        rows.select("doc", "text").mapInArrow(_grams(bits, parts), "part int, codes binary").repartition(parts, "part").sortWithinPartitions("part")
        .mapInArrow(_filter_parts(width), "part int, bits binary")
    )
    out = bytearray(1 << (bits - 3))
    size = 1 << (width - 3)
    for r in settle(found, "repeats-filter").toLocalIterator():  # written, which frees the shuffled codes
        out[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return pa.compress(out, codec="zstd", asbytes=True)


def _bitmap(shared, bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(shared.value, decompressed_size=1 << (bits - 3), codec="zstd"), np.uint8)


def _suffixes(shared, bits: int, bitmap: np.ndarray | None = None):
    """Rows of the anchors whose gram is shared: the bytes before it and behind its gram, as far as its strings reach.

    `at` holds the place (from bit 10), and the distances of the first and the last string before it (5 bits each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _bitmap(shared, bits) if bitmap is None else bitmap
        for whole in batches:
            for _, batch in _slices(whole, 1):
                data, offsets, (text, place, gram, low, high) = _anchors_of(batch.column(1))
                bit = _place_of(gram, bits).astype(np.int64)
                on = (known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
                text, place, gram, low, high = text[on], place[on], gram[on], low[on], high[on]
                raw = data.tobytes()
                left = [raw[a:b] for a, b in zip(low.tolist(), place.tolist(), strict=True)]
                right = [raw[a:b] for a, b in zip((place + GRAM).tolist(), (high + LENGTH).tolist(), strict=True)]
                index = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), batch.column(0).take(index), batch.column(2).take(index),
                        pa.array((place - offsets[text]) << 10 | (place - low) << 5 | (place - high), pa.int64()),
                    ],
                    ["gram", "left", "right", "doc", "row", "at"],
                )

    return run


def _contexts(shared, bits: int):
    """The distinct contexts of a batch with the smallest and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _bitmap(shared, bits)
        for whole in batches:
            rows = pa.Table.from_batches(list(_suffixes(shared, bits, bitmap)(iter([whole]))), None) if whole.num_rows else None
            if rows is not None and rows.num_rows:
                found = rows.group_by(["gram", "left", "right"]).aggregate([("doc", "min"), ("doc", "max")]).select(["gram", "left", "right", "doc_min", "doc_max"])
                yield from found.rename_columns(["gram", "left", "right", "doc", "top"]).to_batches(max_chunksize=20_000)

    return run


SUFFIXES = "gram long, left binary, right binary, doc long, row long, at long"


def _sides(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before the anchors as rows that end together, bytes behind the grams as rows that begin together, and their counts."""
    step = np.arange(REACH)
    (data, offsets), (more, begins) = utf8(left), utf8(right)
    most, size = np.diff(offsets), np.diff(begins)
    data, more = np.r_[np.zeros(REACH, np.uint8), data], np.r_[more, np.zeros(REACH, np.uint8)]
    before = np.where(step >= REACH - most[:, None], data[offsets[1:, None] + step], np.uint8(0))
    after = np.where(step < size[:, None], more[begins[:-1, None] + step], np.uint8(0))
    return before, most, after, size


def _induced(gram: np.ndarray, before: np.ndarray, most: np.ndarray, after: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For contexts sorted by (gram, right): a bit for each distance at which the string also begins in a smaller document.

    Neighbours carry the length of their common prefix. The strings that begin at a distance d before the anchor are
    induced from it: two are equal when the d bytes before the anchor are (known from distance d - 1 and one more byte)
    and the suffixes at the anchor share 50 - d bytes, which the common prefixes of the sorted order tell. The right bytes
    begin behind the gram, which is the same for all contexts of one hash.
    """
    n = len(gram)
    least = REACH - size
    prefix = np.zeros(n, np.int64)  # shared with the row before
    prefix[1:] = np.where(gram[1:] == gram[:-1], GRAM + np.minimum.accumulate(after[1:] == after[:-1], axis=1).sum(1), -1)
    prefix[:1] = -1
    masks, ahead = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for d in range(REACH + 1):
        if d:
            ahead = mixed(ahead * MIX + before[:, REACH - d] + np.uint64(1))
        on = np.flatnonzero((least <= d) & (d <= most))
        if not len(on):
            continue
        key = mixed(ahead[on] + np.cumsum(prefix < LENGTH - d).astype(np.uint64)[on] * MIX)
        order = np.argsort(key)
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        smallest = np.minimum.reduceat(doc[on][order], starts)
        lowest = np.empty(len(on), np.int64)
        lowest[order] = np.repeat(smallest, np.diff(np.append(starts, len(on))))
        masks[on] |= (lowest < doc[on]).astype(np.int64) << d
    return masks


def _induce(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Sorted distinct contexts with their masks, about `most` at a time, whole grams; the last gram waits for what follows."""
    held: list[pa.RecordBatch] = []

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        gram, sides = table.column(0).to_numpy(), _sides(table.column(1), table.column(2))
        new = np.ones(table.num_rows, bool)  # not a copy that another task has too
        new[1:] = gram[1:] != gram[:-1]
        for x in sides:
            x = x.reshape(len(x), -1)
            new[1:] |= (x[1:] != x[:-1]).any(1)
        first = np.flatnonzero(new)
        doc, top = np.minimum.reduceat(table.column(3).to_numpy(), first), np.maximum.reduceat(table.column(4).to_numpy(), first)
        gram, masks = gram[first], np.zeros(len(first), np.int64)
        again = gram[1:] == gram[:-1]
        several = np.flatnonzero(np.r_[again, False] | np.r_[False, again])  # the only context of a gram has nobody before it
        masks[several] = _induced(gram[several], *(x[first[several]] for x in sides), doc[several])
        return pa.RecordBatch.from_arrays([table.column(5).take(pa.array(first)), pa.array(doc), pa.array(top > doc), pa.array(masks)], ["context", "first", "docs", "mask"])

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
        whole = cut > 0 or (held and gram[0] != held[-1].column(0)[-1].as_py())  # what comes before the cut is whole grams
        if whole and count + cut >= most:
            yield done([*held, batch.slice(0, cut)])
            held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield done(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the marks of their anchors (place and mask): what is left, and the counts."""
    for whole in batches:
        sizes, removed, spans, kept = [], [], [], []
        (raw, offsets), marks = utf8(whole.column(1)), whole.column(2)
        ends, flat = marks.offsets.to_numpy(), marks.values.to_numpy()
        for t in range(whole.num_rows):
            data, mark = raw[offsets[t] : offsets[t + 1]], flat[ends[t] : ends[t + 1]]
            at, distance = np.nonzero(mark[:, None] >> np.arange(REACH + 1) & 1)
            begins = (mark[at] >> (REACH + 1)) - distance
            covered = np.bincount(begins, minlength=len(data) + 1) - np.bincount(begins + LENGTH, minlength=len(data) + 1)
            gone = np.cumsum(covered[:-1]) > 0
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            kept.append(data[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([whole.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, bits: int = 29) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes).

    A byte goes if a string of 50 bytes that covers it also begins in a document of smaller doc_id; strings are judged on
    the input and never cross documents. A null text is empty; a null doc_id is larger than all others, rows of one doc_id
    are one document. Texts of under 50 bytes stay whole. Other columns are ignored.

    Suffixes are sorted sparsely. Each string has one anchor that depends on its bytes alone. Grams at anchors that no two
    documents share are dropped by a bitmap of 2^bits places, whose size is fixed (64 MB); it only spares work and loses
    nothing. Grams count as equal if their 64-bit hashes are. The suffixes at the other anchors, with equal contexts of a batch combined first, are sorted by Spark, which spills to
    disk; in that order neighbours carry their common prefixes, and the strings that begin before an anchor are induced
    from it byte by byte. The distinct contexts of one gram meet in one task.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("row"))
    shared = spark.sparkContext.broadcast(shared_grams(rows, bits))
    context = F.xxhash64("gram", "left", "right")
    suffixes = rows.mapInArrow(tidied(_suffixes(shared, bits)), SUFFIXES).select(context.alias("context"), "doc", "row", "at")
    contexts = rows.mapInArrow(tidied(_contexts(shared, bits)), "gram long, left binary, right binary, doc long, top long")
    # written before the places of anchors are shuffled: the contexts, the largest part of what is sent, are gone by then
    induced = settle(
        contexts.repartition("gram").withColumn("context", context).sortWithinPartitions("gram", "right", "left")
        .mapInArrow(tidied(_induce), "context long, first long, docs boolean, mask long").filter("docs OR mask != 0"),
        "repeats-induced",
    )
    # a copy of a context in a later document goes as a whole; in the first document only what the mask says
    all_of = F.expr("shiftleft(1L, int(shiftright(at, 5) & 31) + 1) - shiftleft(1L, int(at & 31))")
    marks = (
        suffixes.join(induced, "context").withColumn("mask", F.when(F.col("doc") > F.col("first"), all_of).otherwise(F.col("mask"))).filter("mask != 0")
        .groupBy("doc", "row").agg(F.collect_list(F.expr(f"shiftleft(shiftright(at, 10), {REACH + 1}) | mask")).alias("marks"))
    )
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"))
    return whole.join(marks, ["doc", "row"], "left").select("doc_id", "text", "marks").mapInArrow(tidied(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
