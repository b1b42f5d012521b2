"""Benchmark decontamination: latent semantic retrieval of passages, then a longest-common-subsequence and answer check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import MIX, bounded_batches, hash_words, mixed, slices, tidied, utf8

#: words of half a passage; a passage is two neighbours, so the next one begins in its middle
HALF = 32
#: passages of items in a pass over the documents, about; their vectors are in the latent space as a whole
PIECES = 512
#: terms in a block of a matrix product
BLOCK = 64


def lcs_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence of `words` and the sequence of `size` words whose places `masks` holds, bit by bit."""
    full = (1 << size) - 1
    row = full
    for word in words:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def longest_run(masks: dict[int, int], words: list[int]) -> int:
    """Most consecutive words that both sequences share."""
    best = 0
    runs: dict[int, int] = {}
    for word in words:
        now, m = {}, masks.get(word, 0)
        while m:
            at = (m & -m).bit_length() - 1
            now[at] = runs.get(at - 1, 0) + 1
            best = max(best, now[at])
            m &= m - 1
        runs = now
    return best


@dataclass
class Item:
    item_id: int
    words: list[int]
    masks: dict[int, int]
    answer: list[int]
    answer_masks: dict[int, int]


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for at, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << at
    return out


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    words, first = hash_words(*utf8(pa.array(texts, pa.string())))
    return [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _items(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Items with words. The answer is the last sentence, or the last third of a text of one sentence."""
    out = []
    answers = []
    for _, text in rows:
        sentences = [s for s in (text or "").replace("\n", " ").split(". ") if s.split()]
        words = (text or "").split()
        answers.append(sentences[-1] if len(sentences) > 1 else " ".join(words[-max(1, len(words) // 3) :]) if words else "")
    for (item_id, _), words, answer in zip(rows, _hashes([t for _, t in rows]), _hashes(answers), strict=True):
        if len(words):
            w, a = words.tolist(), answer.tolist()
            out.append(Item(item_id, w, _masks(w), a, _masks(a)))
    return out


@dataclass
class Terms:
    """The vocabulary of the items: sorted word hashes and the weight of each."""

    hashes: np.ndarray
    idf: np.ndarray

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)


def _document_frequencies(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, docs = Terms(hashes, hashes), np.zeros(len(hashes) + 1, np.int64), 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            words, first = hash_words(*utf8(batch.column(0)))
            found = terms.find(words)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            pairs = np.unique(text[found >= 0] * len(hashes) + found[found >= 0])
            counts[:-1] += np.bincount(pairs % len(hashes), minlength=len(hashes))
            counts[-1] += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["term", "n"])

    return run


def _halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each half passage, and the half passage of each word."""
    sizes = np.diff(first)
    counts = -(-sizes // HALF)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    number = np.arange(counts.sum()) - begin[text]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return text, number, begin[owner] + (np.arange(sizes.sum()) - first[:-1][owner]) // HALF


def _sums(table: np.ndarray, row: np.ndarray, weight: np.ndarray | None, groups: np.ndarray, count: int) -> np.ndarray:
    """Sums of rows of a table by group; groups are sorted. The first member of every group is added, then the second, ..."""
    out = np.zeros((count, table.shape[1]), np.float32)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(groups)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    for k in range(int(sizes.max(initial=0))):
        at = starts[: np.searchsorted(-sizes, -k)] + k
        part = table[row[at]]
        out[groups[at]] += part if weight is None else part * weight[at, None]
    return out


def _gram_times(words: np.ndarray, first: np.ndarray, terms: Terms, right: np.ndarray) -> np.ndarray:
    """A'(A right), A being the TF-IDF rows of the half passages. Rows keep their length: rare words are what tells items apart."""
    _, number, half = _halves(first)
    found = terms.find(words)
    on = found >= 0
    v, g = found[on], half[on]
    weight = terms.idf[v].astype(np.float32)
    rows = _sums(right, v, weight, g, len(number))
    out = [np.bincount(v, column[g] * weight, len(terms.hashes)) for column in np.ascontiguousarray(rows.T)]
    return np.array(out).reshape(right.shape[1], -1).T


def _partial_product(terms: Terms, right: np.ndarray):
    """The product of a task's passages, in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(terms.hashes), right.shape[1]))
        for batch in (part for whole in batches for part in slices(whole, 0)):
            total += _gram_times(*hash_words(*utf8(batch.column(0))), terms, right)
        blocks = [total[at : at + BLOCK].astype(np.float32).tobytes() for at in range(0, len(total), BLOCK)]
        part = [TaskContext.get().partitionId()] * len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], ["block", "part", "total"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, part, total) to the sum of each block; one block is held at a time."""
    block, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "total"])

    for batch in batches:
        for b, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    yield row()
                block, total = b, 0.0
            total = total + np.frombuffer(part, np.float32).astype(np.float64)
    if block is not None:
        yield row()


def _pieces(items: list[Item]) -> list[tuple[int, list[int]]]:
    """Item number and words of every passage of the items: an item longer than a passage is looked for by each of its passages."""
    return [(i, item.words[a : a + 2 * HALF]) for i, item in enumerate(items) for a in range(0, max(1, len(item.words) - HALF), HALF)]


def latent_space(texts: DataFrame, items: list[Item], terms: Terms, rank: int, seed: int = 11) -> np.ndarray:
    """Orthonormal directions of the term space: all passages of the items, and the first singular vectors of the TF-IDF passages
    of texts(text) among what the items leave. There are `rank` of them, more if the items' passages take over three quarters.

    The vector of an item lies in this space as a whole, so a text that holds the item has all of it there, and its cosine is no
    smaller than without the projection. Randomized subspace iteration: each task multiplies its own passages, only blocks of the
    products are shuffled and added up.
    """
    pieces = _pieces(items)
    own = np.zeros((len(terms.hashes), len(pieces)))
    for q, (_, words) in enumerate(pieces):
        np.add.at(own[:, q], at := terms.find(np.array(words, np.uint64)), terms.idf[at])
    left, values, _ = np.linalg.svd(own, full_matrices=False)
    own = left[:, values > 1e-9 * max(values.max(initial=0), 1e-30)]
    free = min(max(rank - own.shape[1], rank // 4), len(terms.hashes) - own.shape[1])
    if free < 1:
        return own.astype(np.float32)

    def product(right: np.ndarray) -> np.ndarray:
        right = right.astype(np.float32)
        parts = texts.mapInArrow(tidied(_partial_product(terms, right)), "block int, part int, total binary").repartition("block").sortWithinPartitions("block", "part")
        out = np.zeros(right.shape)
        for r in parts.mapInArrow(tidied(_add_blocks), "block int, total binary").collect():
            rows = np.frombuffer(r["total"], np.float32).reshape(-1, right.shape[1])
            out[r["block"] * BLOCK : r["block"] * BLOCK + len(rows)] = rows
        return out - own @ (own.T @ out)

    def apart(x: np.ndarray) -> np.ndarray:
        return x - own @ (own.T @ x)

    basis = np.linalg.qr(product(apart(np.random.default_rng(seed).normal(size=(len(terms.hashes), free)))))[0]
    basis = np.linalg.qr(apart(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    return np.hstack([own, basis @ turn[:, values > 1e-9 * max(values.max(initial=0), 1e-30)]]).astype(np.float32)


def _run_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out = (out + words[starts + k]) * MIX + np.uint64(k + 1)
    return mixed(out)


def _item_runs(items: list[Item], run_words: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each run length that counts as a leak (`run_words`, or all words of a shorter item): sorted hashes, and their items."""
    out = []
    for size in sorted({min(run_words, len(i.words)) for i in items}):
        parts = [(i, np.array(item.words, np.uint64)) for i, item in enumerate(items) if min(run_words, len(item.words)) == size]
        hashes = np.concatenate([_run_hashes(w, np.arange(len(w) - size + 1), size) for _, w in parts])
        owner = np.repeat([i for i, _ in parts], [len(w) - size + 1 for _, w in parts])
        order = np.argsort(hashes, kind="stable")
        out.append((size, hashes[order], owner[order]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _shared_runs(words: np.ndarray, first: np.ndarray, half: np.ndarray, on: np.ndarray, runs: list[tuple[int, np.ndarray, np.ndarray]], items: int) -> list[tuple[int, int]]:
    """Passages in whose first half a run of an item begins, and the item."""
    pairs = []
    before = np.concatenate([[0], np.cumsum(on)])
    last = np.repeat(first[1:], np.diff(first))
    for size, hashes, owner in runs:
        starts = np.flatnonzero(before[size:] - before[:-size] == size) if len(words) >= size else np.zeros(0, np.int64)
        starts = starts[starts + size <= last[starts]]
        wanted = _run_hashes(words, starts, size)
        low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        times = high - low
        at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs.append(half[np.repeat(starts, times)] * items + owner[at])
    return [divmod(int(x), items) for x in np.unique(np.concatenate(pairs))]


def _search(items: list[Item], terms: Terms, latent: np.ndarray, cosine: float, contained: float, verbatim: float, similar: float, answered: float, run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = latent * terms.idf[:, None].astype(np.float32)
        pieces, runs = _pieces(items), _item_runs(items, run_words)
        of_piece = np.array([i for i, _ in pieces])
        begin_of = np.searchsorted(of_piece, np.arange(len(items) + 1))
        wanted = np.array([space[terms.find(np.array(w, np.uint64))].sum(0) for _, w in pieces], np.float32)
        least = contained * np.linalg.norm(wanted, axis=1)
        wanted = _unit(wanted)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, first = hash_words(*utf8(batch.column(1)))
            found = terms.find(words)
            text, number, half = _halves(first)
            on = found >= 0
            halves = _sums(space, found[on], None, half[on], len(text))
            passages = halves.copy()
            if len(text):
                joined = text[1:] == text[:-1]
                passages[:-1][joined] += halves[1:][joined]
            length = np.linalg.norm(passages, axis=1)
            near: dict[tuple[int, int], float] = {}  # candidates (passage, item) and their cosine
            for p, i in _shared_runs(words, first, half, on, runs, len(items)):
                close = wanted[begin_of[i] : begin_of[i + 1]] @ passages[p]
                near[p, i] = float(close.max() / max(length[p], 1e-9))
            able = np.flatnonzero(length >= max(float(least.min()), 1e-6))  # others hold too little of any item
            for begin in range(0, len(able), 4096):
                part = able[begin : begin + 4096]
                close = _unit(passages[part]) @ wanted.T
                for at, q in zip(*np.nonzero((close >= cosine) & (close * length[part, None] >= least[None])), strict=True):
                    key = (int(part[at]), int(of_piece[q]))
                    near[key] = max(near.get(key, -1.0), float(close[at, q]))
            hits: dict[tuple[int, int], tuple] = {}
            for (p, i), close in near.items():
                item, t = items[i], int(text[p])
                size = len(item.words)
                low = max(first[t], first[t] + number[p] * HALF - size)
                region = words[low : min(first[t + 1], first[t] + (number[p] + 2) * HALF + size)].tolist()
                share = lcs_length(item.masks, size, region) / size
                if share < min(similar, run_words / size):
                    continue
                answer = lcs_length(item.answer_masks, len(item.answer), region) / max(len(item.answer), 1)
                longest = longest_run(item.masks, region)
                if share >= verbatim or longest >= min(run_words, size) or share >= similar and answer >= answered:
                    row = (share, answer, longest, min(close, 1.0))
                    hits[t, i] = max(hits.get((t, i), row), row)
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[t], items[i].item_id, *row) for (t, i), row in hits.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["doc_id", "item_id", "lcs_share", "answer_share", "longest_run", "cosine"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 128, cosine: float = 0.3, contained: float = 0.3, verbatim: float = 0.8, similar: float = 0.6,
    answered: float = 0.6, run_words: int = 13, items_a_pass: int = 2000,
) -> DataFrame:
    """Pairs of docs(doc_id, text) and benchmark(item_id, text) of which the document holds the item: doc_id, item_id,
    lcs_share, answer_share, longest_run, cosine. One row per pair; rows that repeat a doc_id count as one document.

    Candidates: every place where `run_words` words of an item stand in a row (all, for a shorter item), found exactly by
    hashes of word runs; and passages of 64 words, the next beginning 32 words later, over the whole of every text, whose
    cosine with a passage of an item in the latent space is at least `cosine`, and which hold at least the share `contained`
    of the item's vector. The space holds the vectors of all items of a pass and singular vectors of the TF-IDF passages of
    all documents over the words of the items (see latent_space); document frequencies are counted over all documents. A
    candidate holds the item when, around the passage, `run_words` of its words stand in a row (all, for a shorter item), or
    the longest common subsequence covers `verbatim` of its words, or it covers `similar` of them and `answered` of the
    answer: the item's last sentence (a paraphrase).

    Null or empty texts hold nothing, items without words are held by none, equal items are all reported; other columns
    are ignored. Items go through in groups of at most about `items_a_pass` items and PIECES of their passages, each with its
    own passes over the documents, so that a task holds one group whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    columns = "doc_id long, item_id long, lcs_share double, answer_share double, longest_run long, cosine double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    n_words = F.size(F.filter(F.split("text", "[\t-\r ]+"), lambda w: w != ""))
    sizes = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.greatest(F.lit(1), F.ceil((n_words - HALF) / HALF))).alias("pieces")).first()
    groups = max(-(-sizes["items"] // items_a_pass), -(-(sizes["pieces"] or 0) // PIECES))
    found = spark.createDataFrame([], columns)
    for group in range(groups):
        part = _items([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).orderBy("item_id", "text").collect()])
        if not part:
            continue
        hashes = np.unique(np.concatenate([np.array(i.words, np.uint64) for i in part]))
        counted = rows.select("text").mapInArrow(tidied(_document_frequencies(hashes)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(hashes) + 1)
        for r in counted:
            counts[r["term"]] = r["n"]
        terms = Terms(hashes, np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.05)
        latent = latent_space(rows.select("text"), part, terms, rank)
        found = found.unionByName(rows.mapInArrow(tidied(_search(part, terms, latent, cosine, contained, verbatim, similar, answered, run_words)), columns))
    best = F.max(F.struct("lcs_share", "answer_share", "longest_run", "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no item of the benchmark; all columns, unchanged. A doc_id that holds one goes with all its rows."""
    held = leaks(docs, benchmark).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, docs["doc_id"].eqNullSafe(F.col("__held")), "left_anti")
