import random

import pytest
from pyspark.sql import functions as F

from groundwell.operators import blocks as B
from groundwell.operators import chunks as C
from groundwell.operators import normalize as N
from groundwell.plans import ingest as P


def kinds(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = B.lines_to_blocks(P.text_lines(docs), nfkc=True).orderBy("block_no").collect()
    return [(r.kind, r.text) for r in rows]


def test_structure_of_a_guide(spark):
    text = "# Incident Guide\r\nwhen the queue grows\nkeep calm and go on\n\nEscalation:\n- call the owner\nQ: who decides?\nAnswer: the lead does\n"
    assert kinds(spark, text) == [
        ("heading", "Incident Guide"), ("paragraph", "when the queue grows\nkeep calm and go on"),
        ("heading", "Escalation"), ("list_item", "- call the owner"), ("qa_pair", "Q: who decides?"),
        ("qa_pair", "A: the lead does"),
    ]


def test_tables_and_numbered_headings(spark):
    assert kinds(spark, "2.1 Queue Depth\nsignal | meaning | action\nit's a 3rd try for the api\n") == [
        ("heading", "2.1 Queue Depth"), ("table_row", "signal | meaning | action"),
        ("paragraph", "it's a 3rd try for the api"),
    ]


def test_margins_are_removed_on_every_page(spark):
    rows = []
    for page in (1, 2, 3):
        word = ["alpha", "beta", "gamma"][page - 1]
        lines = ["Support Runbook", f"{word} text goes here", f"more {word} of it", f"Page {page} of 3"]
        rows += [(1, page, n, t) for n, t in enumerate(lines, 1)]
    lines = spark.createDataFrame(rows, "doc_id bigint, page_number int, line_no int, text string")
    left = B.strip_margins(lines, B.page_margin_keys(lines))
    assert left.filter("text LIKE 'Support%' OR text LIKE 'Page%'").count() == 0 and left.count() == 6
    info = B.extraction_warnings(lines, left).first()
    assert info.removed_margin_lines == 6 and "repeated_page_margins_removed" in info.warnings


def normal(spark, text, kind="paragraph"):
    df = spark.createDataFrame([(1, 0, kind, text)], "doc_id bigint, block_no int, kind string, text string")
    return N.normalize_blocks(df)


def test_dehyphenation_and_flags(spark):
    row = normal(spark, "it was suc-\ncessful and\nthen over\n@@@@ ####").first()
    assert row.text == "it was successful and then over"
    assert row.normalization_flags == ["dehyphenated_breaks", "noise_lines_removed", "soft_wrap_joins"]


@pytest.mark.parametrize("text, code", [("...", "EMPTY_DOCUMENT"), ("@@@ ### --- *** !!! ???\n" * 8, "LOW_QUALITY_EXTRACTION"),
                                        ("a plain sentence of more than twenty letters", None)])
def test_quality_gate(spark, text, code):
    assert N.quality_gate(normal(spark, text)).first().error_code == code


def test_heading_path_follows_stack_length(spark):
    rng = random.Random(7)
    blocks, expected, stack = [], {}, []
    for n in range(60):
        if rng.random() < 0.5:
            level = rng.randint(1, 7)
            while stack and len(stack) >= min(level, 6):
                stack.pop()
            stack.append(f"h{n}")
            blocks.append((1, n, "heading", f"h{n}", level, None))
        else:
            blocks.append((1, n, "paragraph", f"p{n}", None, None))
            expected[f"p{n}"] = list(stack)
    df = spark.createDataFrame(blocks, "doc_id bigint, block_no int, kind string, text string, heading_level int, qa_label string")
    assert {r.text: r.section_path for r in C.assign_sections(df).collect()} == expected


def brute_merge(sizes, target, low):
    groups, index = [], 0
    while index < len(sizes):
        members, total = [index], sizes[index]
        while total < low and index + 1 < len(sizes) and total + sizes[index + 1] <= target:
            index += 1
            members.append(index)
            total += sizes[index]
        if len(members) == 1 and total < low and groups and sum(sizes[i] for i in groups[-1]) + total <= target:
            groups[-1] += members
        else:
            groups.append(members)
        index += 1
    return [g + 1 for g, members in enumerate(groups) for _ in members]


def test_section_merge_against_brute_force(spark):
    rng = random.Random(1)
    cases = [[rng.choice([3, 10, 25, 60, 130]) for _ in range(rng.randint(1, 12))] for _ in range(120)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, sizes array<int>")
    got = {r.i: r.g for r in df.select("i", C.merge_small_sections("sizes", 120).alias("g")).collect()}
    assert got == {i: brute_merge(c, 120, C.section_minimum(120)) for i, c in enumerate(cases)}


def brute_group(units, limit, overlap):
    done, current, index = [], [], 0
    while index < len(units):
        if not current or sum(units[i][0] for i in current) + units[index][0] <= limit:
            current.append(index)
            index += 1
            continue
        done.append(current)
        carried, tokens = [], 0
        for i in reversed(current):
            if units[i][1]:
                continue
            carried.insert(0, i)
            tokens += units[i][0]
            if tokens >= overlap:
                break
        while carried and sum(units[i][0] for i in carried) + units[index][0] > limit:
            carried.pop(0)
        current = carried
    return done + [current] if current else done


@pytest.mark.parametrize("overlap", [0, 20, 45])
def test_grouping_with_overlap_against_brute_force(spark, overlap):
    rng = random.Random(overlap)
    cases = [[(rng.randint(1, 70), rng.random() < 0.2) for _ in range(rng.randint(1, 25))] for _ in range(80)]
    rows = [(i, [(n, t, h) for n, (t, h) in enumerate(c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, units array<struct<i:int,tokens:int,heading:boolean>>").withColumn("room", F.lit(100))
    got = {r.i: r.g for r in df.select("i", C.group_units("units", "room", overlap).alias("g")).collect()}
    assert got == {i: brute_group(c, 100, overlap) for i, c in enumerate(cases)}


def test_question_and_answer_share_a_chunk_and_no_text_is_lost(spark):
    body = "\n".join(f"Sentence number {i} has some words in it." for i in range(60))
    text = f"# Faq\nQ: how do I reset?\nA: press the red button\nQ: and then?\nA: wait a minute\n\n## Long part\n{body}\n"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = P.ingest_documents(docs, 70, 8).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == list(range(1, len(rows) + 1))
    assert "Q: how do I reset?\nA: press the red button" in rows[0].content and rows[0].contains_structured_content
    joined = " ".join(r.content for r in rows)
    assert all(f"Sentence number {i} has" in joined for i in range(60))
    again = P.ingest_documents(docs, 70, 8).orderBy("chunk_no").collect()
    assert [r.checksum for r in again] == [r.checksum for r in rows]


def test_write_path_has_one_exchange(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    plan = P.ingest_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
