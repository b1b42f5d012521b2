"""Toxicity by a classifier chain: linear models in a row, each sees what the earlier ones predicted."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, hash_sample, settle

#: order of the chain; the last one needs both of the others
CATEGORIES = ("low_quality", "toxic", "severe")
STEMS = (4, 5, 6)
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHAPE = 4


def terms_of(text: str | None) -> set[bytes]:
    """Distinct words of a whole text in lower case, and their first bytes with a mark."""
    words = set((text or "").lower().encode().translate(_TABLE).split())
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in STEMS))


def shape_of(text: str | None) -> list[float]:
    """Log length, and the shares of letters and digits, of capitals and of distinct words."""
    text = text or ""
    words = text.split()
    size = max(len(text), 1)
    letters = sum(map(len, text.encode().lower().translate(_TABLE).split()))
    return [np.log1p(len(text)), letters / max(len(text.encode()), 1), sum(map(str.isupper, words)) / max(len(words), 1), len(set(words)) / max(len(words), 1) if size > 1 else 0.0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Sparse rows: present terms of each row, and dense columns."""

    row: np.ndarray
    term: np.ndarray
    dense: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        here = keep[self.row]
        return Rows(number[self.row[here]], self.term[here], self.dense[keep])


class Logistic:
    """Logistic regression on sparse and dense columns, fitted with Adam over all rows; L2 on all weights but the bias."""

    def __init__(self, terms: int, dense: int, l2: float = 2e-5):
        self.sparse, self.dense, self.bias, self.l2 = np.zeros(terms), np.zeros(dense), np.zeros(1), l2

    def logits(self, x: Rows) -> np.ndarray:
        return np.bincount(x.row, self.sparse[x.term], len(x.dense)) + x.dense @ self.dense + self.bias

    def fit(self, x: Rows, y: np.ndarray, steps: int = 80, rate: float = 0.15) -> Logistic:
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (self.sparse, self.dense, self.bias)]
        for step in range(1, steps + 1):
            error = (sigmoid(self.logits(x)) - y) / max(len(y), 1)
            slopes = (np.bincount(x.term, error[x.row], len(self.sparse)) + self.l2 * self.sparse, x.dense.T @ error + self.l2 * self.dense, np.array([error.sum()]))
            for (p, first, second), g in zip(state, slopes, strict=True):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return self


def significant(docs: list[set[bytes]], labels: np.ndarray, most: int, least: float = 20.0) -> list[bytes]:
    """Terms whose presence depends on any label: likelihood ratio G2 of the 2 x 2 table above `least`, the `most` best."""
    total, best = len(docs), {}
    seen = Counter(t for d in docs for t in d)
    often = {t for t, n in seen.items() if n >= 3}
    for y in labels.T:
        inside = Counter(t for d, flag in zip(docs, y, strict=True) if flag for t in d if t in often)
        n1 = int(y.sum())
        if not 0 < n1 < total:
            continue
        terms = sorted(inside)
        a = np.array([inside[t] for t in terms], float)
        b = np.array([seen[t] for t in terms], float) - a
        g2 = np.zeros(len(terms))
        for have, side, rows in ((a, n1, a + b), (n1 - a, n1, total - a - b), (b, total - n1, a + b), (total - n1 - b, total - n1, total - a - b)):
            expected = side * rows / total
            g2 += 2 * have * np.log(np.where(have > 0, have, 1) / np.where(have > 0, expected, 1))
        for t, g in zip(terms, g2, strict=True):
            if g >= least:
                best[t] = max(best.get(t, 0.0), float(g))
    return sorted(sorted(best, key=lambda t: (-best[t], t))[:most])


def best_threshold(probs: np.ndarray, y: np.ndarray) -> float:
    """Where F1 of held-out predictions is best; the lowest of equals, half way to the next prediction, 0.05 to 0.5."""
    order = np.argsort(-probs, kind="stable")
    p, hits = probs[order], np.cumsum(y[order])
    f1 = 2 * hits / np.maximum(np.arange(1, len(p) + 1) + y.sum(), 1)
    at = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]) if len(p) else 0
    after = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + after) / 2 if len(p) else 0.5, 0.05, 0.5))


class Chain:
    """A logistic model for each category, on the text and on the probabilities of the categories before it."""

    def __init__(self, terms: list[bytes]):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.models: list[Logistic] = []
        self.thresholds: list[float] = []
        self.center, self.spread = np.zeros(SHAPE), np.ones(SHAPE)

    def rows(self, texts: list[str | None], terms: list[set[bytes]] | None = None) -> Rows:
        known = self.terms.keys()
        found = [sorted(self.terms[t] for t in known & d) for d in (terms or map(terms_of, texts))]
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        dense = np.array([shape_of(t) for t in texts], float).reshape(len(found), SHAPE)
        return Rows(row, np.array([i for f in found for i in f], np.int64), np.clip((dense - self.center) / self.spread, -3, 3))

    def fit(self, texts: list[str | None], terms: list[set[bytes]], labels: np.ndarray, folds: np.ndarray) -> Chain:
        raw = np.array([shape_of(t) for t in texts], float).reshape(len(texts), SHAPE)
        self.center, self.spread = raw.mean(0), raw.std(0) + 1e-6
        x = self.rows(texts, terms)
        for y in labels.T.astype(float):
            size = x.dense.shape[1]
            outside = np.full(len(y), y.mean())
            for fold in np.unique(folds):  # each row's input to the next model comes from a model that did not see the row
                rest = folds != fold
                if rest.any():
                    outside[~rest] = sigmoid(Logistic(len(self.terms), size).fit(x.take(rest), y[rest]).logits(x.take(~rest)))
            self.thresholds.append(best_threshold(outside, y))
            self.models.append(Logistic(len(self.terms), size).fit(x, y))
            x = Rows(x.row, x.term, np.column_stack([x.dense, outside]))
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x, out = self.rows(texts), []
        for model in self.models:
            out.append(sigmoid(model.logits(x)))
            x = Rows(x.row, x.term, np.column_stack([x.dense, out[-1]]))
        return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, positives: int = 2500, negatives: int = 5000, terms: int = 4000, folds: int = 5) -> Chain | None:
    """A chain fitted on a bounded sample of labelled documents; None if no label belongs to a document.

    The sample is the `positives` toxic and `negatives` other labelled documents of smallest hash of doc_id; the bounds hold
    for any size of the tables. Of several labels of a document the worst counts; null labels count as clean.
    """
    worst = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).alias("quality"))
    known_docs = settle(worst.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "toxicity-labels")
    picked = hash_sample(known_docs.filter("toxic > 0"), positives, "doc_id").unionByName(hash_sample(known_docs.filter("toxic <= 0"), negatives, "doc_id"))
    # at most positives + negatives rows; of rows that repeat a doc_id the first text in order counts
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "quality").agg(F.min("text").alias("text")).orderBy("doc_id")
    sample = texts.toLocalIterator()
    known, bags, shown, folded, once = [], [], [], [], {}
    for r in sample:
        low = r["quality"] <= 0
        known.append((low, r["toxic"] > 0, low and r["toxic"] > 0))
        bags.append({once.setdefault(t, t) for t in terms_of(r["text"])})  # texts share their terms
        shown.append(r["text"])
        folded.append(zlib.crc32(str(r["doc_id"]).encode()) % folds)
    if not known:
        return None
    flags = np.array(known)
    return Chain(significant(bags, flags, terms)).fit(shown, bags, flags, np.array(folded))


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, a probability for each category, and toxic.

    toxic is true from the probability on at which the predictions held out in training were best.

    Whole texts are scored; a null text is empty. Without a chain all probabilities are 0. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [f"p_{c}" for c in CATEGORIES]
    if chain is None:
        return rows.select("doc_id", *[F.lit(0.0).alias(n) for n in names], F.lit(False).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probs = chain.predict(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, pa.float64()) for p in probs.T], pa.array(probs[:, 1] >= chain.thresholds[1])], ["doc_id", *names, "toxic"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
