import math

import pytest
from pyspark.sql import functions as F

from groundwell.functions import scoring as S
from groundwell.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_quoted_phrase_is_kept_and_stop_words_go(spark):
    df = spark.createDataFrame([(1, 'What is the latest “Reset  Worker” policy?')], "query_id int, question string")
    row = T.preprocess(df).first()
    assert row.phrases == ["reset worker"]
    assert row.tokens == ["latest", "reset", "worker", "policy"]
    assert row.lexical_text == '"reset worker" latest policy'
    assert row.freshness_intent and row.question_like


def test_odd_quotes_are_dropped(spark):
    assert one(spark, T.quoted_query(F.lit('say "hello world'))) == "say hello world"


def test_nfkc_changes_only_what_it_must(spark):
    df = spark.createDataFrame([("ﬁle №5 ①",), ("déjà vu",), (None,), ("éte",)], "t string")
    assert [r.t for r in T.with_nfkc(df, "t").collect()] == ["file No5 1", "déjà vu", None, "éte"]


@pytest.mark.parametrize("distance, score", [(0.0, 1.0), (1.0, 0.5), (2.0, 0.0), (math.nan, 0.0)])
def test_semantic_score(spark, distance, score):
    assert one(spark, S.semantic_score(F.lit(distance))) == score


@pytest.mark.parametrize("rank, score", [(0.0, 0.0), (0.5, 1 / 3), (3.0, 0.75), (-1.0, 0.0)])
def test_lexical_rank(spark, rank, score):
    assert one(spark, S.lexical_rank_norm(F.lit(rank))) == pytest.approx(score)


def test_jaccard(spark):
    near = S.jaccard(T.terms(F.lit("reset worker queue now")), T.terms(F.lit("reset worker queue later now")))
    assert one(spark, near) == pytest.approx(0.8)
    assert one(spark, S.jaccard(T.terms(F.lit("")), T.terms(F.lit("alpha")))) == 0


def test_metadata_terms_skip_other_keys_and_non_strings(spark):
    text = '{"Tags":["Queue depth", 5, ["deep"]],"owner":"nobody","category":"Ops","label":7}'
    assert sorted(one(spark, T.metadata_terms(F.lit(text)))) == ["depth", "ops", "queue"]


@pytest.mark.parametrize("name, safe", [
    ("a/b/My Report (1).PDF", "My-Report-1-.PDF.pdf"), ("report.txt", "report.txt"), (".txt", None), ("x..txt", "x.txt"),
])
def test_safe_filename(spark, name, safe):
    assert one(spark, T.safe_filename(F.lit(name))) == safe


def test_eval_category(spark):
    assert one(spark, T.eval_category(F.lit(" Out-of scope "))) == "out_of_scope"
    assert one(spark, T.eval_category(F.lit(None).cast("string"))) == "general"


def test_usage_counts_reads_both_spellings(spark):
    old = F.lit('{"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}')
    assert one(spark, T.usage_counts(old)["input_tokens"]) == 3
    assert one(spark, T.usage_counts(old)["reasoning_tokens"]) == 0
