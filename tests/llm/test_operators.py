"""Each operator against brute force or a library, and on odd rows."""

import base64
import collections
import hashlib
import re
from pathlib import Path

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwell.llm import bpe, decontam, exact, huffman, langid, licenses, minhash, repeats, shards, toxicity
from groundwell.llm.common import hash_sample

RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


# --- byte-level BPE ---------------------------------------------------------------------------------------------------
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (60, 20)])
def test_bpe_equals_tiktoken_and_round_trips(odd, chunk, overlap):
    own = tiktoken_encoding()
    got = bpe.decode(bpe.encode(odd, RANKS, tokenizers.PATTERN, chunk, overlap), RANKS, tokenizers.PATTERN).collect()
    want = sorted((-1 if i is None else i, np.array(own.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts_of(odd))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_bpe_piece_longer_than_the_overlap_is_encoded_whole(spark):
    text = "word " * 20 + "z" * 500 + " word" * 20
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, tokenizers.PATTERN, 60, 20).first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == tiktoken_encoding().encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_pieces_split_as_the_library_does(text):
    words = bpe.Vocabulary(open(RANKS, "rb").read(), tokenizers.PATTERN)
    ids = words.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding_cached().encode_ordinary(text)
    assert words.decode(ids) == text.encode()


_OWN = []


def tiktoken_encoding_cached():
    if not _OWN:
        _OWN.append(tiktoken_encoding())
    return _OWN[0]


def test_bpe_empty_table(none):
    assert bpe.digests(none, RANKS, tokenizers.PATTERN).count() == 0


# --- shards -----------------------------------------------------------------------------------------------------------
def test_shards_balance_and_keep_groups(spark, odd, none):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(400)] + [(1000 + i, "hot") for i in range(200)]
    got = shards.lpt_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.01 * loads.sum() and got["size"].sum() == sum(len(t) + 1 for _, t in rows)
    assert got[got.doc_id >= 1000].shard.nunique() == 1
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in got.groupby("shard"))
    assert shards.lpt_shards(odd, 3).count() == odd.count() and shards.lpt_shards(none, 3).count() == 0


def test_least_loaded_is_longest_processing_time():
    loads = [0, 0, 0]
    assert shards.least_loaded([(5, 0), (4, 1), (3, 2), (3, 3), (3, 4)], loads) == [0, 1, 2, 2, 1] and loads == [5, 7, 6]


# --- licences ---------------------------------------------------------------------------------------------------------
def test_license_phrases_against_brute_force(spark, odd, none):
    extra = [(50, "CC  BY, cc-by; General Public License. all rights, reserved. CC BYX"), (51, "Licensed under the Apache License, Version 2.0."), (52, "licensed under the apache pie, version 2.0")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.scan_licenses(docs).collect()
    want = []
    for doc_id, text in texts_of(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        want.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[51] == ("apache-2.0", 1.0) and labels[52] == ("", 0.0)
    assert licenses.scan_licenses(none).count() == 0


def test_every_notice_is_found_in_a_longer_text(spark):
    rows = [(i, f"some words before; {words.title()} - and after, {i} times") for i, (_, words, _) in enumerate(licenses.NOTICES)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].split(",") for i, (label, _, _) in enumerate(licenses.NOTICES))


# --- near duplicates --------------------------------------------------------------------------------------------------
def bags(text):
    words = re.findall(r"[^\t\n\x0b\x0c\r ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def classes_by_brute_force(rows):
    texts = sorted({t for _, t in rows})
    sets, parent = {t: bags(t) for t in texts}, {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if either and both >= 0.8 * either - 1e-12:
                parent[find(a)] = find(b)
    first = {}
    for i, t in rows:
        root = find(t)
        first[root] = min((x for x in (first.get(root), i) if x is not None), default=None)
    return sorted(((i, first[find(t)]) for i, t in rows), key=str)


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(120)) for _ in range(3)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(90):  # copies with 0 to 9 changed words: links, chains of links and near misses
        words = base[i % 3].split()
        for _ in range(int(rng.integers(0, 10))):
            words[int(rng.integers(0, len(words)))] = f"v{rng.integers(0, 10_000)}"
        rows.append((200 + i, " ".join(words)))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == classes_by_brute_force(texts_of(docs))
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("with_base", [True, False])
def test_differing_pairs_join_what_all_pairs_join(spark, with_base):
    """Edited copies whose edits overlap in part, repeated words and a second group in the same cluster: the components are
    those of all links, and copies that have only edits of their own make no pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{i % 70}" for i in range(100)]
    texts = [" ".join(base)] if with_base else []
    for i in range(70):
        words = list(base)
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(0, 25)) * 4
            words[at] = f"v{at}" if rng.random() < 0.5 else f"u{i}x{at}"
        texts.append(" ".join(words))
    other = [f"o{i}" for i in range(40)]
    texts += [" ".join(other[:k] + ["z"] + other[k:]) for k in range(0, 40, 8)]
    texts = sorted(set(texts))
    named = [(str(i).zfill(3).encode(), t) for i, t in enumerate(texts)]
    counted = minhash.shingle_counts(spark.createDataFrame(named, "node binary, text string"))
    nodes = spark.createDataFrame([(n, n, b"one") for n, _ in named], "node binary, root binary, cluster binary")
    pairs = minhash.differing_pairs(nodes, counted, 0.8)
    got = {(int(r["a"]), int(r["b"])) for r in pairs.collect()}
    sets = [bags(t) for t in texts]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()) - 1e-12}

    def parts(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return {tuple(i for i, x in enumerate(label) if x == y) for y in label}

    assert parts(got & links) == parts(links) and len(got) < len(sets) * (len(sets) - 1) / 4
    # ten copies of 400 words, each with eight changed words of its own: 0.66 alike, and no pair is made
    own = [" ".join(f"own{i}-{k}" if k % 50 == 5 * i else f"b{k}" for k in range(400)) for i in range(10)]
    frame = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(own)], "node binary, text string")
    apart = frame.select("node", F.col("node").alias("root"), F.lit(b"one").alias("cluster"))
    assert minhash.differing_pairs(apart, minhash.shingle_counts(frame), 0.8).count() == 0


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 9)) for i in range(200)}
    b = {i: int(rng.integers(1, 9)) for i in range(50, 250)}
    exact_value = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(250)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(250))
    element = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = minhash.bag_minhash(element, np.array([0] * len(a) + [1] * len(b)), np.array([*a.values(), *b.values()], float), 2, 6000)
    assert abs((got[0] == got[1]).mean() - exact_value) < 0.03


# --- repeated passages ------------------------------------------------------------------------------------------------
def repeats_by_brute_force(rows):
    last = 2**63 - 1
    first = {}
    for i, t in rows:
        data = t.encode()
        for at in range(len(data) - 49):
            w = data[at : at + 50]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, t in rows:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for at in range(len(data) - 49):
            if first[data[at : at + 50]] < (last if i is None else i):
                gone[at : at + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 3, 6))
    shared = [" ".join(word() for _ in range(n)) for n in (6, 8, 9, 20)] + ["ab" * 60, "a" * 130]
    rows = [(100 + i, " ".join([word(), word()] + [shared[int(k)] + word() for k in rng.integers(0, len(shared), 3)])) for i in range(40)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, 20).collect()]
    assert sorted(got, key=str) == repeats_by_brute_force(texts_of(docs))
    assert repeats.remove_repeats(none, 20).count() == 0


def test_contexts_are_gone_before_places_are_shuffled(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven " * 3) for i in range(4)], "doc_id long, text string")
    plan = repeats.remove_repeats(docs, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # places of anchors and the cut; contexts and induction are written


def test_induction_does_not_depend_on_how_rows_are_batched():
    rng = np.random.default_rng(7)
    strings = [bytes(97 + rng.integers(0, 2, int(rng.integers(0, repeats.REACH + 1))).astype(np.uint8)) for _ in range(12)]
    pick = lambda: strings[int(rng.integers(len(strings)))]
    rows = sorted((int(rng.integers(0, 60)), pick(), pick(), int(rng.integers(0, 9))) for _ in range(400))
    gram, right, left, doc = zip(*rows)
    table = pa.table({"gram": gram, "left": left, "right": right, "doc": doc, "top": [d + i % 2 for i, d in enumerate(doc)], "context": [hash(r[:3]) for r in rows]})
    found = [pa.Table.from_batches(list(repeats._induce(iter(table.to_batches(max_chunksize=size)), most))) for size, most in ((400, 1), (1, 1), (7, 30), (7, 1 << 14))]
    assert found[0].num_rows == len({r[:3] for r in rows}) and all(f.equals(found[0]) for f in found)
    assert repeats._induce(iter([])) and not list(repeats._induce(iter(table.slice(0, 0).to_batches())))


def test_texts_that_share_nothing_send_few_suffixes(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(97, 123, 1500).astype(np.uint8).tobytes().decode(), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc long, text string, row long")
    shared = spark.sparkContext.broadcast(repeats.shared_grams(docs, 20))
    total = sum(len(repeats._anchors_of(pa.array([text]))[2][0]) for _, text, _ in rows)
    assert docs.mapInArrow(repeats._suffixes(shared, 20), repeats.SUFFIXES).count() < 0.15 * total


@given(st.lists(st.integers(0, 2**24), unique=True), st.sampled_from([1, 1 << 12]))
def test_codes_are_read_as_they_were_written(codes, scale):
    codes = np.unique(np.array(codes, np.int64) // scale)
    assert repeats._decoded(repeats._coded(codes)).tolist() == codes.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=160).map(lambda b: bytes(97 + x % 2 for x in b).decode()), min_size=1, max_size=4))
def test_each_string_has_one_anchor(texts):
    data, offsets, (text, place, gram, low, high) = repeats._anchors_of(pa.array(texts))
    begins = sorted(i for a, b in zip(low.tolist(), high.tolist()) for i in range(a, b + 1))
    assert begins == [i for a, b in zip(offsets[:-1], offsets[1:]) for i in range(a, b - 49)]
    assert ((place >= high) & (place - low <= repeats.REACH)).all()


# --- token files ------------------------------------------------------------------------------------------------------
def test_token_files_equal_the_library(odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    huffman.write_tokens(odd, path, str(tmp_path / "a"), block=300)
    got = huffman.read_tokens(odd.sparkSession, str(tmp_path / "a")).orderBy("start").collect()
    want = collections.Counter((i, tuple([*own.encode(t, add_special_tokens=False).ids, 2])) for i, t in texts_of(odd))
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i)) and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    huffman.write_tokens(none, path, str(tmp_path / "b"))
    assert huffman.read_tokens(odd.sparkSession, str(tmp_path / "b")).count() == 0


def test_a_word_is_merged_once_whatever_stands_beside_it():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    words, own = huffman.WordTokenizer(Path(path).read_text()), Tokenizer.from_file(path)
    merged = []
    merge, words._word = words._word, lambda word: merged.append(word) or merge(word)
    text = "zyxq, zyxq. (zyxq) zyxq's zyxq\x1czyxq zyxq\u00a0zyxq, \u00e9tud\u00e9, \u00e9tud\u00e9! \u4e2d\u6587\u3002 zyxq7 77"
    assert np.frombuffer(words.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged))


def test_added_tokens_in_a_text_get_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|startoftext|>It's<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "e<|startoftext|>\u0301 \u00c9<|<|endoftext|>|>"]
    huffman.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, str(tmp_path / "a"))
    got = huffman.read_tokens(spark, str(tmp_path / "a")).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert np.frombuffer(got[0]["ids"], "<u4").tolist() == [3306, 49407, 1002, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(6, 12))
def test_huffman_round_trip_and_optimal_lengths(ids, limit):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41), limit)
    assert lengths.max(initial=0) <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    code = huffman.Code(lengths)
    payload, segments = code.pack(ids) if len(ids) else (b"", b"")
    assert code.unpack(payload, segments, len(ids)).tolist() == ids.tolist()


# --- decontamination --------------------------------------------------------------------------------------------------
def test_leaks_verbatim_and_paraphrased(spark, odd, none):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(12)] + [(98, None), (99, "")]
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(500 + i, f"{fill(70)} {t} {fill(50)}") for i, t in items[:6]]
    for i, t in items[6:9]:  # every fifth word replaced, the answer kept
        words = t.split()
        rows.append((500 + i, f"{fill(40)} {' '.join(w if k % 5 or k > 29 else word() for k, w in enumerate(words))} {fill(40)}"))
    rows += [(600 + i, fill(200)) for i in range(20)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, rank=16, items_a_pass=5).collect()}
    assert got == {(500 + i, i) for i in range(9)}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_quotes_and_whole_items_with_more_items_than_rank(spark):
    rng = np.random.default_rng(4)
    fill = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 4)) for _ in range(n))
    items = [(i, f"{fill(34)}. {fill(6)}.") for i in range(60)] + [(60, fill(7)), (61, fill(150))]
    other = " ".join(t for _, t in items[40:60]).split()
    mixed_words = lambda n: " ".join(rng.permutation(other)[:n])
    rows = [(i, f"{mixed_words(45)} {t} {mixed_words(45)}") for i, t in items]  # whole items
    rows += [(100 + i, f"{mixed_words(51)} {' '.join(t.split()[9:22])} {mixed_words(60)}") for i, t in items[:40]]  # 13 words of an item
    rows += [(200 + i, f"{mixed_words(51)} {' '.join(t.split()[9:21])} {mixed_words(60)}") for i, t in items[:40]]  # one word less
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, rank=8).collect()}
    assert got == {(i, i) for i, _ in items} | {(100 + i, i) for i in range(40)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_lcs_and_run(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            run[i + 1][j + 1] = run[i][j] + 1 if x == y else 0
            best = max(best, run[i + 1][j + 1])
    masks = decontam._masks(a)
    assert decontam.lcs_length(masks, len(a), b) == table[-1][-1] and decontam.longest_run(masks, b) == best


# --- exact duplicates -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("digest", [None, lambda text: F.char_length(text).cast("string")])
def test_exact_groups_against_brute_force(odd, none, digest):
    rows = texts_of(odd)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t), i is None, i))
    want = sorted(((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    got = exact.exact_groups(odd, salts=3, digest=digest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.exact_groups(none, digest=digest).count() == 0


def test_kept_rows_have_all_columns_once(odd):
    kept = exact.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in texts_of(odd)})
    assert minhash.kept_rows(kept).columns == odd.columns


def test_near_kept_rows_keeps_one_row_of_equal_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words), (1, words + " end"), (2, words), (1, words + " end"), (None, "one"), (None, "one"), (8, "one"), (9, None), (None, "")]
    got = minhash.kept_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, words + " end"), (8, "one"), (9, None)], key=str)


# --- toxicity ---------------------------------------------------------------------------------------------------------
def test_toxicity_chain_learns_and_leaves_clean_texts_alone(spark, odd, none):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(400):
        words, bad, low = [f"w{rng.integers(0, 80)}" for _ in range(30)], i % 4 == 0, i % 5 == 0
        words += ["vexor"] * bad + ["LOWLINE"] * low
        rows.append((100 + i, " ".join(words)))
        marks.append((100 + i, 0 if low else 1, int(bad)))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([m for m in marks if m[0] % 3] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i]["toxic"] == bool(t) for i, _, t in marks) and not got[4]["toxic"]
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(none, None).count() == 0 and not any(r["toxic"] for r in toxicity.score(odd, None).collect())


def test_chain_inputs_are_out_of_fold():
    # a later category that equals the first one must not be learned from training answers
    y = np.arange(40) % 2 == 0
    bags_ = [{b"yes"} if v else {b"no"} for v in y]
    chain = toxicity.Chain([b"no", b"yes"]).fit(["x"] * 40, bags_, np.column_stack([y, y, y]), np.arange(40) % 5)
    assert len(chain.models) == 3 and len(chain.models[2].dense) == toxicity.SHAPE + 2


# --- language ---------------------------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, rows=600)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    found = langid.identify(odd, model).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 7)} == {"und"} and len(found) == odd.count()
    assert langid.accepted(odd, model).columns == odd.columns and langid.accepted(odd, None).count() == 7
    assert langid.identify(none, None).count() == 0 and langid.train(none) is None


def test_language_is_learned_behind_a_common_header(spark):
    rng = np.random.default_rng(6)
    header = "This text may be copied and changed by anyone who keeps this notice. " * 10
    rows = [(i, header + " ".join("".join(letters[int(c)] for c in rng.integers(0, 5, 5)) for _ in range(700)), lang) for i in range(240) for lang, letters in (("aa", "aeiou"), ("bb", "tnrsk")) if (i % 2 == 0) == (lang == "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).toPandas()
    assert len(got) > 40 and (got.lang == got.lang_pred).mean() > 0.95


def test_training_windows_come_from_the_whole_text(spark):
    texts = ["", "ab", "x" * 256 + "y", "é" * 300, "".join(f"{i:08d}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: [bytes(x) for x in r[1] or ()] for r in docs.select("doc_id", langid.drawn_windows(F.col("text"), 2, 256, F.col("doc_id"))).collect()}
    cuts = {i: [t.encode()[a : a + 256] for a in range(0, len(t.encode()), 256)] for i, t in enumerate(texts)}
    assert [got[i] for i in range(3)] == [cuts[i] for i in range(3)]
    assert all(len(got[i]) == 2 and all(w in cuts[i] for w in got[i]) for i in (3, 4))
    assert cuts[4].index(got[4][0]) < 6 <= cuts[4].index(got[4][1])


def test_gradients_of_the_byte_network():
    model = langid.ByteConv(["a", "b"], embed=3, filters=2, window=12)
    model.params = {k: v.astype(float) for k, v in model.params.items()}
    x, y, w = np.random.default_rng(0).integers(0, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 1, 0, 1]), np.ones(5)

    def loss():
        probs = model.predict(x, tuple(t.astype(float) for t in model.tables()))
        return -np.log(probs[np.arange(5), y]).mean()

    grads = model._loss_gradients(x, y, w)
    for name in ("k2", "k3", "k4", "out", "b3"):
        at = tuple(0 for _ in grads[name].shape)
        model.params[name][at] += 1e-2
        up = loss()
        model.params[name][at] -= 2e-2
        down = loss()
        model.params[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-2


# --- helpers and pipeline ---------------------------------------------------------------------------------------------
def test_hash_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    one = {r[0] for r in hash_sample(rows, 50, "doc_id").collect()}
    assert len(one) == 50 and one == {r[0] for r in hash_sample(rows.repartition(13), 50, "doc_id").collect()}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()}
    leaked = {r["doc_id"] for r in decontam.leaks(docs, spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    kept = {r["doc_id"] for r in exact.exact_groups(docs).filter("kept").collect()} - leaked
    near = {r["doc_id"] for r in minhash.near_duplicates(docs).filter("class_id = doc_id").collect()}
    assert got <= kept and len((kept & near) - got) <= 2
