"""Licence scan: phrases, and notices found through their rarest words by relative position."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import bounded_batches, rows_of

# --- fixed values: phrases whose places are counted, and their labels -------------------------------------------------
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: notices: label, words, and the key phrases of which one must stand at its place for the label to be given
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "http www apache org licenses license 2 0"),
    ),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        ("permission is hereby granted free of charge",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list "
        "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
        ("terms of the gnu general public license", "version 3 of the license"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

#: bytes of words: digits, a-z (A-Z are made lower) and everything outside ASCII; the rest separates
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: runs of digits, letters and characters outside ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


class NoticeIndex:
    """Positional postings of the notices' words."""

    def __init__(self, notices=NOTICES, phrases=None):
        self.notices = [(label, words.encode().split(), [key.encode().split() for key in keys]) for label, words, keys in notices]
        self.phrases = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.notices):
            for at, word in enumerate(words):
                self.postings[word].append((t, at))
        self.postings = dict(self.postings)
        # all places of each mandatory phrase in its notice
        self.keys = [
            [(key, at) for key in keys for at in range(len(words) - len(key) + 1) if words[at : at + len(key)] == key] for _, words, keys in self.notices
        ]

    @property
    def vocabulary(self) -> list[bytes]:
        return sorted(self.postings)


def _frequencies(index: NoticeIndex):
    """Of each notice word, the documents of a task that hold it."""
    known = frozenset(index.postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = dict.fromkeys(known, 0), 0
        for (text,) in rows_of(batches, "text"):
            rows += 1
            for word in known.intersection(words_of(text)):
                counts[word] += 1
        words = [b"", *counts]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([rows, *counts.values()], pa.int64())], ["word", "n"])

    return run


class Scanner:
    def __init__(self, index: NoticeIndex, idf: dict[bytes, float], rarest: int, share: float):
        self.index, self.idf, self.rarest, self.share = index, idf, rarest, share
        self.weight = [sum(idf[w] for w in words) for _, words, _ in index.notices]
        # a notice is looked up by its own rarest words: every place of it has them unless the notice is changed there
        self.wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.least = []  # rare words that must agree in position, or the rest of the notice can't reach the share
        for t, (_, words, _) in enumerate(index.notices):
            best = sorted(set(words), key=lambda w: (-idf[w], w))[:rarest]
            for at, word in enumerate(words):
                if word in best:
                    self.wanted[word].append((t, at))
            self.least.append(sum(idf[w] for w in words if w in best) - (1 - share) * self.weight[t])
        self.wanted = dict(self.wanted)
        self.starts = defaultdict(list)
        for words, label in index.phrases:
            self.starts[words[0]].append((words, label))
        self.look = frozenset(self.wanted) | frozenset(self.starts)

    def scan(self, words: list[bytes]) -> tuple:
        """n_base, first_word, last_word, base labels, all labels, score of one document."""
        look = self.look
        if look.isdisjoint(words):
            return 0, None, None, "", "", 0.0
        places: list[int] = []
        base, labels, score = set(), set(), 0.0
        aligned: dict[tuple[int, int], float] = defaultdict(float)
        for at, word in enumerate(words):
            if word not in look:
                continue
            for phrase, label in self.starts.get(word, ()):
                if words[at : at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
            for t, inside in self.wanted.get(word, ()):
                aligned[t, at - inside] += self.idf[word]
        for (t, begin), agreed in aligned.items():
            if agreed < self.least[t] - 1e-9:
                continue
            label, notice, _ = self.index.notices[t]
            if not any(words[begin + at : begin + at + len(key)] == key for key, at in self.index.keys[t] if begin + at >= 0):
                continue
            same = sum(self.idf[w] for at, w in enumerate(notice, begin) if 0 <= at < len(words) and words[at] == w)
            if same >= self.share * self.weight[t]:
                labels.add(label)
                score = max(score, min(1.0, same / self.weight[t]))
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for (text,) in rows_of(iter([batch]), "text"):
                words = words_of(text)
                n_words.append(len(words))
                found.append(scanner.scan(words))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, index: NoticeIndex | None = None, rarest: int = 4, share: float = 0.8) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are those where the words of a phrase stand consecutively; places of all phrases are counted.
    labels adds the notices: the inverse document frequency of every notice word is counted over all documents; a notice
    is looked up by its `rarest` words of highest frequency weight; their places in the document, less their places in the
    notice, give the candidate beginnings; a beginning holds if one mandatory phrase stands at its place and the words that
    agree there carry at least `share` of the notice's weight. score is the best such share, else 0. A null or empty text
    has no words, no labels and score 0. Other columns are ignored.

    Two passes over the texts without a shuffle of them; counts of the notice vocabulary (a few hundred words) reach the driver.
    """
    bounded_batches(docs.sparkSession)
    index = index or NoticeIndex()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.select("text").mapInArrow(_frequencies(index), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in counted}
    total = counts.pop(b"", 0)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in index.vocabulary}
    columns = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts.mapInArrow(_scan(Scanner(index, idf, rarest, share)), columns)
