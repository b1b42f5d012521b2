"""Byte-level BPE: texts to token ids and back. Long texts are cut into overlapping chunks that are worked on in parallel."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, once_a_worker, rows_of, settle, tidied

#: a boundary this close to the end of a chunk may still depend on characters beyond it (the longest contraction has 3)
GUARD = 4
#: ids in binary columns: little-endian unsigned 32-bit
ID = np.dtype("<u4")

_LOADED: dict[tuple, "Vocabulary"] = {}


class Vocabulary:
    """Ranks of a vocabulary file, the splitting pattern, and a bounded memory of pieces met before."""

    def __init__(self, file: bytes, pattern: str, remembered: int = 100_000):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        # white space is the Unicode property here, as in the rank files' own library
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.piece = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.remembered, self.known = remembered, {}

    @staticmethod
    def of(shared, pattern: str) -> "Vocabulary":
        """The vocabulary of a broadcast file, read once in each worker."""
        return once_a_worker(_LOADED, shared.value, pattern, make=lambda: Vocabulary(shared.value, pattern))

    def _new(self, piece: str) -> bytes:
        ids = array("I", self.piece(piece.encode())).tobytes()
        if len(self.known) < self.remembered:  # frequent pieces come early; later rare ones are merged anew
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, new = self.known.get, self._new
        return b"".join([known(p) or new(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, ID).tolist()))

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Starts of the pieces in [low, high) when the text is split from its beginning."""
        out = []
        for m in self.pattern.finditer(text):
            if m.start() >= high:
                break
            if m.start() >= low:
                out.append(m.start())
        return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _encode_whole(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared, pattern)
        for batch in batches:
            ids = [words.encode(text or "") for text in _column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """Overlapping chunks of each text; `from` is where a chunk begins in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, doc_id, text in rows_of(batches, "uid", "doc_id", "text"):
            last = (len(text) - 1) // chunk
            for n in range(last + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([n], pa.int32()), pa.array([n == last]), pa.array([text[n * chunk : (n + 1) * chunk + overlap]], pa.string())],
                    ["uid", "doc_id", "n", "last", "text"],
                )

    return run


def _pretokenize(shared, pattern: str, chunk: int, overlap: int):
    """Adds the piece boundaries in both overlaps of a chunk, as places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared, pattern)
        for batch in batches:
            heads, tails = [], []
            for n, last, text in rows_of(iter([batch]), "n", "last", "text"):
                at = n * chunk
                heads.append([at + b for b in words.boundaries(text, 0, overlap)] if n else [])
                tails.append([] if last else [at + b for b in words.boundaries(text, chunk, len(text) - GUARD)])
            spots = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, spots), pa.array(tails, spots)], [*batch.schema.names, "head", "tail"])

    return run


def _encode_owned(shared, pattern: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared, pattern)
        for batch in batches:
            ids = [words.encode(text[low - n * chunk : None if high is None else high - n * chunk]) for n, text, low, high in rows_of(iter([batch]), "n", "text", "low", "high")]
            yield pa.RecordBatch.from_arrays([*[_column(batch, c) for c in ("uid", "doc_id", "n")], pa.array(ids, pa.binary())], ["uid", "doc_id", "n", "ids"])

    return run


def _encode_joined(shared, pattern: str, chunk: int):
    """Chunks sorted by text and number: put the text together again and encode it as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared, pattern)
        parts: list[str] = []
        for uid, doc_id, last, text in rows_of(batches, "uid", "doc_id", "last", "text"):
            parts.append(text if last else text[:chunk])
            if last:
                ids, parts = words.encode("".join(parts)), []
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([0], pa.int32()), pa.array([ids], pa.binary())], ["uid", "doc_id", "n", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by text and number, joined to one row a text."""
    now, parts = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["doc_id", "ids"])

    for uid, doc_id, ids in rows_of(batches, "uid", "doc_id", "ids"):
        if now is not None and now[0] != uid:
            yield row()
            parts = []
        now = (uid, doc_id)
        parts.append(ids)
    if now is not None:
        yield row()


def load(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value; its size is fixed (under 1 MB for 50,000 ids)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, ids (binary, little-endian unsigned 32-bit token ids).

    Each match of `pattern` is merged by the ranks of the file at `path`; a null text is empty and an empty one has no
    ids. Texts of up to `chunk` characters are encoded where they are read. Longer ones are cut into chunks that overlap;
    the chunks, spread over all tasks, are split into pieces, and the first piece boundary that two neighbours share is
    where the second one takes over: the pattern looks at nothing before a piece, so from there on both would agree. A
    text where two neighbours share none (a piece longer than the overlap) is encoded as a whole instead. Other columns
    are ignored.
    """
    if overlap <= 2 * GUARD or chunk <= overlap:
        raise ValueError("chunk must exceed overlap, and overlap must exceed the guard")
    bounded_batches(docs.sparkSession)
    shared = load(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = rows.filter(~long).mapInArrow(tidied(_encode_whole(shared, pattern)), "doc_id long, ids binary")

    columns = "uid long, doc_id long, n int, last boolean, text string"
    chunks = settle(
        rows.filter(long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(tidied(_cut(chunk, overlap)), columns)
        .repartition(F.col("uid"), F.col("n")).mapInArrow(tidied(_pretokenize(shared, pattern, chunk, overlap)), columns + ", head array<long>, tail array<long>"),
        "bpe-chunks",
    )
    order = Window.partitionBy("uid").orderBy("n")
    meet = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    met = chunks.select("uid", "n", "head", "tail").withColumn("low", meet).select("uid", "n", "low")
    met = met.withColumn("high", F.lead("low").over(order)).withColumn("apart", F.max(F.col("low").isNull()).over(Window.partitionBy("uid")))
    owned = chunks.drop("head", "tail").join(met, ["uid", "n"])
    stitched = owned.filter(~F.col("apart")).mapInArrow(tidied(_encode_owned(shared, pattern, chunk)), "uid long, doc_id long, n int, ids binary")
    whole = owned.filter("apart").repartition("uid").sortWithinPartitions("uid", "n").mapInArrow(tidied(_encode_joined(shared, pattern, chunk)), "uid long, doc_id long, n int, ids binary")
    pieces = stitched.unionByName(whole).repartition("uid").sortWithinPartitions("uid", "n").mapInArrow(tidied(_assemble), "doc_id long, ids binary")
    return short.unionByName(pieces)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens(doc_id, ids) with the raw bytes of all ids, concatenated, as `decoded`. Null ids are empty."""
    bounded_batches(tokens.sparkSession)
    shared = load(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared, pattern)
        for batch in batches:
            texts = [words.decode(ids or b"") for ids in _column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), _column(batch, "ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode docs(doc_id, text): doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    done = decode(encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
