"""Winnowing, approximation-file clustering and the Merkle manifest against brute force, and on odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwell.llm import merkle, vafile, winnow


# --- winnowing --------------------------------------------------------------------------------------------------------
def plain_marks(winnower, text):
    """Every window looked at on its own."""
    if not text:
        return {}
    k = min(winnower.k, len(text))
    hashes = [int(winnower._hashes(np.frombuffer(text[i : i + k].encode("utf-32-le"), "<u4"))[0]) for i in range(len(text) - k + 1)]
    width = min(winnower.window, len(hashes))
    found = {}
    for begin in range(len(hashes) - width + 1):
        low = min(hashes[begin : begin + width])
        at = max(i for i in range(begin, begin + width) if hashes[i] == low)
        found[at] = low
    return found


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab\x00é漢", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_marks_equal_every_window_and_survive_packing(text, k, window):
    winnower = winnow.Winnower(k, window)
    values, places = winnower.marks(text)
    assert dict(zip(places.tolist(), values.tolist(), strict=True)) == plain_marks(winnower, text)
    again = winnow.unpack(winnow.pack(values, places))
    assert again[0].tolist() == values.tolist() and again[1].tolist() == places.tolist()


def test_long_text_in_pieces_gives_the_same_marks(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(3000)) + "same " * 100
    winnower = winnow.Winnower()
    whole = winnower.marks(text)
    for piece in (1, 64, 777):
        monkeypatch.setattr(winnow, "PIECE", piece)
        parts = winnower.marks(text)
        assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=60), st.text(alphabet="abc", max_size=60), st.text(alphabet="abcdef", min_size=13, max_size=13))
def test_a_shared_passage_shares_a_mark_inside_it(left, right, passage):
    winnower = winnow.Winnower(5, 9)  # any 13 characters
    one, other = left + passage + "xyz", right + passage
    found = winnow.matches(winnow.pack(*winnower.marks(one)), winnow.pack(*winnower.marks(other)))
    assert any(a - len(left) == b - len(right) and 0 <= a - len(left) <= 8 for a, b in found)


def plain_likeness(rows, k=12, window=20):
    winnower = winnow.Winnower(k, window)
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        marks = [set(plain_marks(winnower, t).values()) for t in (text, edited, after)]
        near = [len(marks[0] & m) / len(marks[0] | m) if marks[0] | m else 1.0 for m in marks[1:]]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, winnow.pack(*winnower.marks(edited)))
    return out


@pytest.mark.parametrize("parts,size", [(1, 1 << 28), (7, 200), (1, 50)])
def test_edited_likeness_equals_brute_force_over_any_ranges(spark, parts, size):
    words = "lorem ipsum dolor sit amet".split()
    rows = [(i * 7 - 100, " ".join(words[(i * j) % 5] + str(j % (i + 1)) for j in range(i % 23))) for i in range(70)] + [(1000, ""), (1001, "é漢\U0001f600" * 9)]
    docs = spark.createDataFrame([(i, t or None) for i, t in rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["edited_fingerprint"]) for r in winnow.edited_likeness(docs, part_bytes=size, least_parts=parts).collect()}
    assert got == plain_likeness(rows)


def test_winnowing_of_one_row_of_odd_rows_and_of_none(spark, odd, none):
    one = winnow.edited_likeness(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [r["edited_sha256"] for r in one] == [hashlib.sha256(b"abcdab").hexdigest()]
    got = winnow.edited_likeness(odd, part_bytes=64, least_parts=3)
    assert got.count() == odd.count() and winnow.edited_likeness(none).count() == 0
    own = winnow.fingerprints(odd).groupBy("fingerprint").count().collect()
    assert sorted(map(tuple, own)) == sorted(map(tuple, got.groupBy("fingerprint").count().collect()))
    assert winnow.fingerprints(none).count() == 0


def test_ranges_are_dealt_without_python_and_a_task_gives_its_memory_back(spark, odd, monkeypatch):
    wrapped = []
    monkeypatch.setattr(winnow, "tidied", lambda run: wrapped.append(run) or run, raising=False)
    plan = winnow.edited_likeness(odd, part_bytes=64, least_parts=3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert len(wrapped) == 1


# --- approximation file -----------------------------------------------------------------------------------------------
def plain_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in named[:k]]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(
        ((i, c, d, sum(e for _, b, e in last if b == c), sum(e for *_, e in last), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in last), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("dims,k,scale", [(5, 4, 64), (3, 16, 2), (64, 16, 64)])
def test_clusters_equal_brute_force(spark, dims, k, scale):
    drawn = np.random.default_rng(dims).normal(size=(150, dims)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(drawn)] + [(7, drawn[7].tolist())] * 3 + [(None, drawn[3].tolist())]
    got = vafile.cluster_vectors(vectors(spark, rows).repartition(4), k=k, dims=dims, scale=scale, sample=20)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, 3, dims, scale)


def test_cells_bound_every_distance_and_settle_most_rows():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(-40, 40, (400, 8)), rng.integers(160, 200, (400, 8))])
    centroids = np.array([[0] * 8, [180] * 8, [185] * 8])
    cells = vafile.Cells(np.quantile(data[::5], np.arange(1, 16) / 16, axis=0, method="higher").T.astype(np.int64), data.min(axis=0), data.max(axis=0))
    tables = cells.tables(centroids)
    found = cells.encode(data)
    bounds = sum(tables[d][found[:, d]] for d in range(8))
    exact = ((data[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (bounds[:, :3] <= exact).all() and (exact <= bounds[:, 3:]).all()
    nearest, fetched = vafile.assign(found, tables, centroids, lambda rows: data[rows])
    assert nearest.tolist() == exact.argmin(axis=1).tolist() and fetched <= 400


def test_clusters_leave_out_broken_vectors_and_take_few_or_none(spark):
    good = [(1, [0.5, -0.5]), (2, [0.0, 0.25]), (3, [1e30, -1e30])]
    broken = [(4, None), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 0.0]), (8, [float("inf"), 0.0]), (None, []), (9, [1.0, 2.0, 3.0])]
    table = vectors(spark, good + broken).withColumn("cluster", F.lit("clash")).withColumn("distance", F.lit(None))
    got = vafile.cluster_vectors(table, dims=2).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and sorted(r["cluster"] for r in got) == [0, 1, 2] and all(r["distance"] == 0 for r in got)
    assert vafile.cluster_vectors(vectors(spark, broken), dims=2).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------------------------------
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """Top and, for each leaf, the siblings left and right of its path."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(places):
            run = place // 3 * 3
            paths[i].append((level[run:place], level[place + 1 : run + 3]))
            places[i] = place // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source in order:
        by_source[source].sort(key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r)))
        trees[source] = plain_tree([plain_leaf(r) for r in by_source[source]])
    root, upper = plain_tree([trees[s][0] for s in order])
    for source, above in zip(order, upper, strict=True):
        for row, path in zip(by_source[source], trees[source][1], strict=True):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = plain_leaf((*row[:4], text))
            for left, right in path + above:
                node = sha(*left, node, *right)
            proof = sha(*(h for left, right in path + above for h in left + right))
            out.append((row[0], plain_leaf(row), trees[source][0], root, proof, node, node == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("rows_per_source", [[1], [3], [2, 1], [10, 4, 1, 1], [250, 1, 30]])
def test_manifest_equals_brute_force(spark, rows_per_source):
    rows = [(i * 10 + s, [None, "z", "é", "A"][s], None if i % 3 else "en", i, f"line {i}\nand\n" * (i % 3)) for s, n in enumerate(rows_per_source) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(3), merkle.without_newlines()).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_over_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [(i, f"s{i % 40 if i < 40 else 7}", "en", i, f"a\nb {i}") for i in range(150)]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS), merkle.without_newlines()).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_of_odd_rows_and_of_none(odd, none):
    docs = odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("leaf", F.lit(1)).withColumn("grp", F.lit(2))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = merkle.manifest(docs, merkle.without_newlines()).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
    assert merkle.manifest(none.withColumn("n_chars", F.lit(1)), merkle.without_newlines()).count() == 0
