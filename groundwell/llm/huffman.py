"""Token ids as Huffman-coded blocks: global counts, length-limited canonical codes, table-driven decoding."""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, once_a_worker, shared_dir, tidied

#: ids in binary columns: little-endian unsigned 32-bit
ID = np.dtype("<u4")
#: tokens between two checkpoints; the bits between them fit 16 bits for codes of up to 25 bits
SEGMENT = 64

_LOADED: dict[tuple, "WordTokenizer"] = {}


class _Known(dict):
    """Ids of runs of text; those of a run that it does not have are made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, run: str) -> bytes:
        return self.make(run)


class WordTokenizer:
    """A tokenizer file whose words do not influence each other: each distinct word is merged once and remembered."""

    def __init__(self, file: str, remembered: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(file)
        self.model = self.full.model
        self.remembered, self.known = remembered, _Known(self._new)
        content = json.loads(file)
        split, *rest = content["pre_tokenizer"]["pretokenizers"]
        # white space is the Unicode property here, as in the tokenizer
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        if split["behavior"] != "Removed" or not split["invert"] or [x["type"] for x in rest] != ["ByteLevel"]:
            raise ValueError("the tokenizer does not split a text into independent words")
        if any(t[k] for t in content["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError("the tokenizer has added tokens that are not plain strings of the text")
        if self.pattern.search(" ") or "(?=" in split["pattern"]["Regex"] or "(?!" in split["pattern"]["Regex"] or "(?<" in split["pattern"]["Regex"]:
            raise ValueError("words of the tokenizer may depend on white space")
        # str.split takes four control characters for white space that the Unicode property leaves out
        self.separators, self.blanks = "\x1c\x1d\x1e\x1f", regex.compile(r"\p{White_Space}+")
        # added tokens are cut out of the text as it is, the longest first where several begin
        self.added = {t["content"]: np.array([t["id"]], ID).tobytes() for t in content["added_tokens"]}
        self.cuts = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, others follow from 256
        others = iter(range(256, 512))
        self.shown = {b: b if b in plain else next(others) for b in range(256)}

    @staticmethod
    def of(shared) -> "WordTokenizer":
        return once_a_worker(_LOADED, shared.value, make=lambda: WordTokenizer(shared.value))

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _new(self, run: str) -> bytes:
        """Ids of a run of text without white space, from those of its words. Frequent ones come early and are remembered: words for as
        long as there is room, runs of several words for as long as half of it is left."""
        if run.isalpha():  # a run of letters is one word
            words = (run,)
        elif run[-1:].isascii() and run[:-1].isalpha():  # so is what stands before a single other character
            words = run[:-1], run[-1]
        else:
            words = self.pattern.findall(run)
        one = len(words) == 1
        ids = self._word(run) if one else b"".join(map(self.known.__getitem__, words))
        if len(self.known) < (self.remembered if one else self.remembered // 2) and len(run) <= 64:
            self.known[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return b"".join([self.added[part] if part in self.added else self._words(part) for part in self.cuts.split(text)])
        return self._words(text)

    def _words(self, text: str) -> bytes:
        try:
            # Latin-1 has composed letters only, each with one small form: the normalizer's work is to make letters small
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            text = self.full.normalizer.normalize_str(text)
        # no word holds white space and none looks at what stands beside it, so runs without white space are independent
        runs = self.blanks.split(text) if any(x in text for x in self.separators) else text.split()
        return b"".join(map(self.known.__getitem__, runs))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for an id that never occurs."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaves.append(at < len(weights))
    taken = 2 * len(weights) - 2
    for leaf in reversed(leaves):
        own = int(leaf[:taken].sum())
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


class Code:
    """Canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        ids = np.flatnonzero(lengths)
        self.ids = ids[np.argsort(lengths[ids], kind="stable")]
        self.lengths = lengths.astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        spans = np.int64(1) << (self.bits - lengths[self.ids])
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[self.ids] = (np.cumsum(spans) - spans) >> (self.bits - lengths[self.ids])
        # what the next `bits` bits mean; an incomplete code (one id) is filled up with its last id
        table = np.repeat(self.ids, spans) if len(ids) else np.zeros(0, np.int64)
        self.table = np.concatenate([table, np.full((1 << self.bits) - len(table), self.ids[-1] if len(ids) else 0)]).astype(np.int64)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload, and the bits of each segment as checkpoints."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ids) else 0
        word, shift = starts >> 5, 64 - (starts & 31) - size
        wide = self.codes[ids].astype(np.uint64) << shift.astype(np.uint64)
        words = np.zeros(total // 32 + 2, np.int64)
        # codes share no bit, so adding is the same as setting; sums of 32-bit words are exact in doubles
        for part, at in ((wide >> np.uint64(32), word), (wide & np.uint64(0xFFFFFFFF), word + 1)):
            words += np.bincount(at, part.astype(np.float64), len(words)).astype(np.int64)
        payload = words.astype(">u4").tobytes()[: (total + 7) // 8]
        cuts = ends[SEGMENT - 1 :: SEGMENT]
        cuts = np.append(cuts, total) if len(ids) % SEGMENT else cuts
        return payload, np.diff(cuts, prepend=0).astype("<u2").tobytes()

    def unpack(self, payload: bytes, segments: bytes, count: int) -> np.ndarray:
        """The ids of a block; its segments are decoded side by side, one id of each in a step."""
        bits = np.frombuffer(segments, "<u2").astype(np.int64)
        place = np.cumsum(bits) - bits
        data = np.frombuffer(payload + bytes(SEGMENT * self.bits // 8 + 8), np.uint8).astype(np.int64)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((SEGMENT, len(bits)), np.int64)
        mask, room = (1 << self.bits) - 1, 32 - self.bits
        for step in range(SEGMENT):
            got = self.table[(window[place >> 3] >> (room - (place & 7))) & mask]
            out[step] = got
            place = place + self.lengths[got]
        return out.T.reshape(-1)[:count]


def _tokenize(shared, end: int, kind: str):
    """Sorted documents to ids with the end id, numbered within their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, seq = WordTokenizer.of(shared), TaskContext.get().partitionId(), 0
        last = np.array([end], ID).tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                ["part", "seq", "before", "doc_id", "n_tokens", "ids"],
            )

        rows, held, before = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(words.encode(text or "") + last, ID)
                rows.append((seq, before, doc_id, len(ids), ids.astype(kind).tobytes()))
                seq, before, held = seq + 1, before + len(ids), held + len(rows[-1][-1])
                if held > 1 << 24:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def _count(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    return run


def _blocks(code: Code, kind: str, target: int):
    """Consecutive documents of a part, packed together until they have `target` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(r[4], kind) for r in rows])
            payload, segments = code.pack(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[0][0]], pa.int32()), pa.array([rows[0][1]], pa.int64()), pa.array([rows[0][5]], pa.int64()), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[r[3] for r in rows]], pa.list_(pa.int64())), pa.array([segments], pa.binary()), pa.array([payload], pa.binary()),
                ],
                ["part", "seq", "start", "doc_ids", "counts", "segments", "payload"],
            )

        rows, held = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (held >= target or row[0] != rows[-1][0] or row[1] != rows[-1][1] + 1):
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[3]
        if rows:
            yield block(rows)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 2, limit: int = 16, block: int = 65_536) -> None:
    """Write the ids of docs(doc_id, text) below `path`, in ascending doc_id order (null last, then by text).

    `path`/codes holds the code length of every id, `path`/blocks the blocks: part and seq (their order), start (ids
    before the block), doc_ids and counts (ids of each document, the end id included), payload, and segments: the bits of
    every 64 ids, from which a reader can begin anywhere. A block is decoded alone. A null text has the end id only.

    Documents are sorted by range once; ids are written to the shared folder, counted there (at most one row per id and
    task), and packed in a second pass over them without a shuffle. Only the counts of the ids and of the parts reach the
    driver; both are bounded, by the vocabulary and by spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    size = 1 + max(*json.loads(content)["model"]["vocab"].values(), *[t["id"] for t in json.loads(content)["added_tokens"]], end)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(content)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    raw = shared_dir(spark, "token-ids")
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
        .mapInArrow(tidied(_tokenize(shared, end, kind)), "part int, seq long, before long, doc_id long, n_tokens long, ids binary").write.option("compression", "zstd").parquet(raw)
    )
    ids = spark.read.parquet(raw)
    counted = ids.select("ids").mapInArrow(tidied(_count(kind, size)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts) - 1).bit_length()))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    totals = sorted(ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"])
    before = itertools.accumulate((r["n"] for r in totals), initial=0)
    firsts = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, before)], "part int, first long")
    packed = ids.join(F.broadcast(firsts), "part").select("part", "seq", "doc_id", "n_tokens", "ids", (F.col("first") + F.col("before")).alias("start"))
    (
        packed.mapInArrow(tidied(_blocks(Code(lengths), kind, block)), "part int, seq long, start long, doc_ids array<long>, counts array<long>, segments binary, payload binary")
        .write.option("compression", "none").parquet(f"{path}/blocks")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document written below `path`: doc_id, start (ids of all documents before it), n_tokens, ids."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # a row per id of the vocabulary at most
    lengths = np.zeros(max((r["id"] for r in codes), default=0) + 1, np.int64)
    for row in codes:
        lengths[row["id"]] = row["bits"]
    code = Code(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, start, segments, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = code.unpack(payload, segments, sum(counts)).astype(ID)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.parquet(f"{path}/blocks").select("doc_ids", "counts", "start", "segments", "payload")
    return blocks.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")
