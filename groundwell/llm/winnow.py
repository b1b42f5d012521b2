"""Document fingerprints by winnowing: rolling hashes of k characters, the minimum of every window, rightmost on ties."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import MIX, bounded_batches, mixed, parts_for, tidied

#: characters that are hashed at a time; a longer text goes through in overlapping pieces with the same result
PIECE = 1 << 17
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_marks long"
)
_INVERSE = pow(int(MIX), -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Winnower:
    """Marks of texts: for every `window` consecutive k-grams the one of smallest hash, the rightmost of equal ones.

    Any two texts that share window + k - 1 consecutive characters share a mark whose positions lie in that passage.
    A text with fewer k-grams than a window has the mark of its only, shorter window; one shorter than k a mark of its
    whole; an empty one none.
    """

    def __init__(self, k: int = 12, window: int = 20):
        self.k, self.window = k, window
        self.up, self.down = _powers(PIECE + k + window, int(MIX)), _powers(PIECE + k + window, _INVERSE)

    def _hashes(self, points: np.ndarray) -> np.ndarray:
        """Hash of each k-gram from running sums; equal characters give equal hashes wherever they stand."""
        k = min(self.k, len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        # a character counts as its number and one, so that leading zero characters matter
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)], out=sums[1:])
        grams = len(points) - k + 1
        return mixed((sums[k:] - sums[:grams]) * self.down[:grams])

    def _lowest(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the minimum of every window, each once, ascending; windows double in width until they are whole."""
        at, width, whole = np.arange(len(hashes)), 1, min(self.window, len(hashes))
        while width < whole:
            step = min(width, whole - width)
            left, right = at[:-step], at[step:]
            at = np.where(hashes[right] <= hashes[left], right, left)
            width += step
        return np.unique(at)

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions (in characters, ascending) of the marks of a text."""
        if not text:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = []
        reach = self.k + self.window - 2  # a window covers one character more than this
        for begin in range(0, max(1, len(text) - reach), PIECE):
            piece = text[begin : begin + PIECE + reach]
            hashes = self._hashes(np.frombuffer(piece.encode("utf-32-le"), "<u4"))
            at = self._lowest(hashes)
            found.append((hashes[at], at + begin))
        values, places = (np.concatenate(x) for x in zip(*found, strict=True))
        places, first = np.unique(places, return_index=True)  # a minimum may be that of the last window of one piece and the first of the next
        return values[first], places


def pack(values: np.ndarray, places: np.ndarray) -> str:
    """Marks as text: base64 of all 64-bit hashes, then of the distances between places as 32-bit numbers, little-endian."""
    gaps = np.diff(places, prepend=0)
    return base64.b64encode(values.astype("<u8").tobytes() + gaps.astype("<u4").tobytes()).decode("ascii")


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places from `pack`."""
    data = base64.b64decode(fingerprint)
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.cumsum(np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64))


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of distinct mark hashes that two texts have in common; 1 when neither has any."""
    one, other = np.unique(one), np.unique(other)
    if not len(one) and not len(other):
        return 1.0
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both)


def matches(one: str, other: str) -> list[tuple[int, int]]:
    """Places (in one text, in the other) of the marks that two fingerprints share, every pair of equal hashes."""
    (a, at), (b, bt) = unpack(one), unpack(other)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    return [(int(at[i]), int(bt[j])) for i in range(len(a)) for j in order[low[i] : high[i]]]


def fingerprints(docs: DataFrame, k: int = 12, window: int = 20) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (see `pack`), n_marks. A null text is empty; other columns
    are ignored; nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(k, window)
        for batch in batches:
            marks = [winnower.marks(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack(*m) for m in marks], pa.string()), pa.array([len(m[0]) for m in marks], pa.int64())],
                ["doc_id", "fingerprint", "n_marks"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_marks long")


def _order(docs: DataFrame) -> list[Column]:
    """Place of a row: falling doc_id, a null one last; rows of one doc_id by a hash of their text."""
    return [F.col("doc_id").isNull().alias("o1"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("o2"), F.xxhash64("text").alias("o3")]


def edited_likeness(docs: DataFrame, k: int = 12, window: int = 20, part_bytes: int = 256 << 20, least_parts: int = 32) -> DataFrame:
    """One row per row of docs(doc_id, text): its fingerprint, that of its edited text, and how alike they are.

    The edited text is the text with its last floor(n_chars / 3) characters replaced by the first as many (all, if it
    has fewer) of the next document. The next document has the next smaller doc_id, the first one follows the last. Rows of one
    doc_id stand in order of a hash of their text, rows with a null doc_id come last. A null text is empty; an empty
    table gives no rows; other columns are ignored.

    Texts are shuffled once: ranges of doc_id of about part_bytes each, cut at keys of a sample that holds about 64 keys a
    range, are sorted and read in order, so a document meets its follower in the stream of one task. The first document of
    a range is also sent, last, to the range before. The driver and the tasks hold one key a range and nothing else.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["o1", "o2", "o3"]
    keys = rows.select(*_order(rows), F.octet_length("text").alias("size"))
    total = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(F.struct(*names)).alias("first")).first()
    if not total["rows"]:
        return spark.createDataFrame([], RESULT)
    parts = min(parts_for(total["bytes"], part_bytes, least_parts), total["rows"])
    share = min(1.0, 64 * parts / total["rows"])
    drawn = keys.filter(F.xxhash64("o2", "o3") <= min(int(-(2**63) + share * 2**64), 2**63 - 1))
    lowest = drawn.repartitionByRange(parts, *names).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*names)).alias("key"))
    # one key of an existing row a range; the first range begins with the very first row
    bounds = sorted({tuple(total["first"])} | {tuple(r["key"]) for r in lowest.collect()})

    count = len(bounds)
    # no Python worker for this: a key is compared with one key a range
    cuts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key, strict=True)]) for key in bounds])
    placed = rows.withColumns(dict(zip(names, _order(rows), strict=True))).withColumn("key", F.struct(*names))
    part = F.size(F.filter(cuts, lambda cut: cut <= F.col("key"))) - 1
    placed = placed.withColumn("at", F.struct(part.alias("part"), F.array_contains(cuts, F.col("key")).alias("head")))
    before = F.pmod(F.col("at.part") - 1, F.lit(count))
    own, ahead = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("ahead")), F.struct(before.alias("part"), F.lit(True).alias("ahead"))
    sent = placed.withColumn("to", F.explode(F.when(F.col("at.head"), F.array(own, ahead)).otherwise(F.array(own))))
    ordered = (
        sent.select("to.part", "to.ahead", *names, "doc_id", "text").repartitionById(count, "part")
        .sortWithinPartitions("part", "ahead", *names).select("part", "ahead", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(k, window)
        last = None  # part, doc_id, text and marks of the row before
        for batch in batches:
            out = []
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = winnower.marks(text)
                if last is not None and last[0] == part:
                    out.append(_compared(winnower, *last[1:], text, marks))
                # rows sent ahead only end their range
                last = None if ahead else (part, doc_id, text, marks)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_marks"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return ordered.mapInArrow(tidied(run), RESULT)


def _compared(winnower: Winnower, doc_id: int | None, text: str, marks: tuple, after: str, after_marks: tuple) -> tuple:
    replaced = len(text) // 3
    edited = text[: len(text) - replaced] + after[:replaced]
    edited_marks = winnower.marks(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(*marks), pack(*edited_marks),
        likeness(marks[0], edited_marks[0]), likeness(marks[0], after_marks[0]), len(marks[0]),
    )
