"""Language identification with a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, hash_sample, tidied, utf8

WIDTHS = (2, 3, 4)
UNKNOWN = "und"


class ByteConv:
    """Byte embedding, filters of several widths with ReLU and max pooling, and a softmax layer."""

    def __init__(self, labels: list[str], embed: int = 8, filters: int = 8, window: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.filters, self.window = labels, filters, window
        self.params = {"embed": rng.normal(0, 0.3, (256, embed)), "out": rng.normal(0, 0.1, (len(WIDTHS) * filters, len(labels))), "bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.params[f"k{w}"] = rng.normal(0, (2 / (w * embed)) ** 0.5, (w, embed, filters))
            self.params[f"b{w}"] = np.zeros(filters)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _loss_gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross entropy for windows x (n, window) with class numbers y."""
        p, n = self.params, len(x)
        seen, pooled, places = p["embed"][x], [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            out = sum(seen[:, k : k + span] @ p[f"k{w}"][k] for k in range(w)) + p[f"b{w}"]
            places.append(out.argmax(1))
            pooled.append(np.maximum(out.max(1), 0))
        features = np.concatenate(pooled, 1)
        logits = features @ p["out"] + p["bias"]
        logits -= logits.max(1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(1, keepdims=True)
        delta = probs
        delta[np.arange(n), y] -= 1
        delta *= (weight / weight.sum())[:, None]
        grads = {"out": features.T @ delta, "bias": delta.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (delta @ p["out"].T) * (features > 0)
        row = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            g = back[:, i * self.filters : (i + 1) * self.filters]  # only the pooled place of a filter gets a gradient
            grads[f"b{w}"] = g.sum(0)
            grads[f"k{w}"] = np.zeros_like(p[f"k{w}"])
            for k in range(w):
                at = x[row, places[i] + k]
                grads[f"k{w}"][k] = np.einsum("nfd,nf->df", p["embed"][at], g)
                np.add.at(grads["embed"], at, g[:, :, None] * p[f"k{w}"][k].T[None])
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, least_steps: int = 600, size: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConv:
        """Adam over shuffled batches, `least_steps` of them at least; classes weigh the same however rare they are."""
        rng, step = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-least_steps * size // max(len(x), 1)) if len(x) > size else least_steps)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.labels)), 1))[y]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                part = order[at : at + size]
                step += 1
                for k, g in self._loss_gradients(x[part], y[part], weight[part]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    slope = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.params[k] -= (rate * (1 - epoch / epochs) * slope).astype(np.float32)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The convolutions as look-ups: by two bytes (all widths, and the second half of width 4), and by one byte."""
        p, f = self.params, self.filters
        one = {(w, k): p["embed"] @ p[f"k{w}"][k] for w in WIDTHS for k in range(w)}

        def pair(w: int, k: int) -> np.ndarray:
            return (one[w, k][:, None] + one[w, k + 1][None]).reshape(65536, f)

        pairs = np.concatenate([pair(2, 0) + p["b2"], pair(3, 0) + p["b3"], pair(4, 0) + p["b4"], pair(4, 2)], 1)
        return np.ascontiguousarray(pairs.T, np.float32), np.ascontiguousarray(one[3, 2].T, np.float32)

    def predict(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Class probabilities of windows x (n, window)."""
        f, n = self.filters, x.shape[1]
        pairs, single = tables
        both, last = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:], x[:, 2:].astype(np.intp)
        pooled = np.empty((len(x), len(WIDTHS) * f), np.float32)
        for i in range(f):  # one filter at a time: small tables, contiguous rows
            pooled[:, i] = pairs[i].take(both).max(1)
            pooled[:, f + i] = (pairs[f + i].take(both[:, : n - 2]) + single[i].take(last)).max(1)
            pooled[:, 2 * f + i] = (pairs[2 * f + i].take(both[:, : n - 3]) + pairs[3 * f + i].take(both[:, 2:])).max(1)
        logits = np.maximum(pooled, 0) @ self.params["out"] + self.params["bias"]
        probs = np.exp(logits - logits.max(1, keepdims=True))
        return probs / probs.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window. A text is cut from its start; its last window may be shorter."""
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][text] + number * window
    return starts, np.minimum(window, offsets[1:][text] - starts), text


def cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Windows as rows of bytes, filled up with zeros."""
    at = starts[:, None] + np.arange(window)[None]
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    short = np.flatnonzero(lengths < window)
    out[short] *= np.arange(window)[None] < lengths[short, None]
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def drawn_windows(text: Column, most: int, window: int, *keys: Column) -> Column:
    """The bytes of `most` windows of a text, all of them if it has no more: its windows are dealt into `most` stretches of
    about equal length, and a hash of the text and the keys picks one of each."""
    data = text.cast("binary")
    count = F.ceil(F.octet_length(text) / window).cast("long")
    drawn = F.least(count, F.lit(most).cast("long"))

    def pick(j: Column) -> Column:
        begin, end = F.floor(j * count / drawn), F.floor((j + 1) * count / drawn)
        at = begin + F.pmod(F.xxhash64(text, *keys, j), end - begin)
        return F.substring(data, (at * window + 1).cast("int"), F.lit(window))

    return F.when(drawn > 0, F.transform(F.sequence(F.lit(0).cast("long"), drawn - 1), pick))


def train(docs: DataFrame, rows: int = 4000, windows_a_text: int = 2, window: int = 256, seed: int = 7) -> ByteConv | None:
    """A model from the `rows` labelled rows of smallest hash that have a letter; None without any label.

    `rows` bounds the sample whatever the size of the table; each row gives `windows_a_text` windows from all over its text
    (see drawn_windows). Rows of held-out documents and rows without a language are not learned from. The sample does not depend on the partitioning.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    picked = hash_sample(labelled.filter(has_letter(F.col("text"))), rows, "doc_id", "text", "lang")
    drawn = drawn_windows(F.col("text"), windows_a_text, window, F.col("doc_id"), F.col("lang"))
    sample = picked.select("lang", F.explode(drawn).alias("bytes")).collect()
    if not sample:
        return None
    labels = sorted({r["lang"] for r in sample})
    data, offsets = utf8(pa.array([r["bytes"] for r in sample], pa.binary()))
    starts, lengths, text = windows(data, offsets, window)
    y = np.array([labels.index(r["lang"]) for r in sample])[text]
    return ByteConv(labels, window=window, seed=seed).fit(cut(data, starts, lengths, window), y, seed=seed)


def _predictor(model: ByteConv, block: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        names = np.array(model.labels, object)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            starts, lengths, text = windows(data, offsets, model.window)
            sums = np.zeros((batch.num_rows, len(names)))
            for at in range(0, len(starts), block):
                part = slice(at, at + block)
                probs = model.predict(cut(data, starts[part], lengths[part], model.window), tables)
                np.add.at(sums, text[part], probs * lengths[part, None])
            total = sums.sum(1)
            known = np.array(batch.column(2).to_pylist(), bool) & (total > 0)
            best = sums.argmax(1)
            score = np.divide(sums.max(1), total, out=np.zeros(len(total)), where=known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0), pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: ByteConv | None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, lang_pred, score.

    Every window of the whole text is classified; the mean of the probabilities, weighted by the bytes of the windows,
    gives the language and its score. `und` with score 0 where the text is null, empty or without a letter, and
    everywhere if nothing could be learned. Ties go to the language first in the alphabet. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("letter"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(tidied(_predictor(model)), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: ByteConv | None, least: float = 0.3) -> DataFrame:
    """Rows of docs in a language that could be told: not `und`, and with a score of at least `least`; all columns, unchanged.

    Works where the rows are read, without a join. Without a model nothing is rejected but texts without a letter.
    """
    bounded_batches(docs.sparkSession)
    lettered = docs.filter(has_letter(F.col("text")))
    if model is None:
        return lettered
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(model)
        for batch in batches:
            if batch.num_rows:
                ids, letters = pa.nulls(batch.num_rows, pa.int64()), pa.array([True] * batch.num_rows)
                scores = next(predict(iter([pa.RecordBatch.from_arrays([ids, batch.column(at), letters], ["doc_id", "text", "letter"])]))).column(2)
                yield batch.filter(pc.greater_equal(scores, least))

    return lettered.mapInArrow(tidied(run), docs.schema)
