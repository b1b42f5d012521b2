"""Text expressions: query preparation, term sets, slugs, titles. All of them stay inside the JVM,
except compatibility normalization, which Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundwell.functions import fixed_values as V

_SPACES = r"(?U)\s+"
_TERM_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# Code points that compatibility normalization leaves alone, whatever their neighbours in this class are.
_NFKC_STABLE = (
    r"^[\x00-\x7FÀ-ÿĀ-ıĴ-ľŁ-ňŊ-ž"
    r"ƠơƯưẠ-ỹ‐–—‘’“”•]*$"
)


def strings(values: list[str]) -> Column:
    """A constant array of strings; the optimizer folds the split into one literal."""
    return F.split(F.lit("|".join(values)), r"\|")


# The white space characters of Unicode, for trimming without a pattern.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


@F.pandas_udf(StringType())
def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def with_nfkc(df: DataFrame, *names: str) -> DataFrame:
    """Apply Unicode compatibility normalization to columns.

    Only texts holding a character that may change travel to Python; for the rest the
    Arrow batch carries a null.
    """
    for name in names:
        text = F.col(name)
        changed = _nfkc_batch(F.when(~text.rlike(_NFKC_STABLE), text))
        df = df.withColumn(name, F.coalesce(changed, text))
    return df


def normalize_whitespace(df: DataFrame, name: str) -> DataFrame:
    return with_nfkc(df, name).withColumn(name, collapse(F.col(name)))


def quoted_query(text: Column) -> Column:
    """Question text with straight quotes and only letters, digits, blanks and -_/.:" left.
    An odd number of quotes means they do not pair up, so all are dropped."""
    straight = F.translate(text, "“”‘’", "\"\"''")
    kept = collapse(F.regexp_replace(straight, r'(?U)[^\p{L}\p{N}\s\-_/.:"]', " "))
    unbalanced = F.regexp_count(kept, F.lit('"')) % 2 == 1
    return F.when(unbalanced, collapse(F.replace(kept, F.lit('"'), F.lit(" ")))).otherwise(kept)


def quoted_phrases(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(quoted_query(text)), F.lit('"([^"]+)"'), 1)
    trimmed = F.transform(found, collapse)
    return F.array_distinct(F.filter(trimmed, lambda p: F.length(p) >= 2))


def terms(text: Column) -> Column:
    """Distinct lower-case terms of two or more characters, stop words out, in first-seen order."""
    cleaned = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s\-_/.:]", " ")
    words = F.transform(F.split(cleaned, _SPACES), lambda w: F.regexp_replace(w, _TERM_EDGE, ""))
    stop = strings(V.STOP_WORDS)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def words_by_position(text: Column) -> Column:
    """Lexical positions of a document: lower-case runs of letters and digits, stop words kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def phrase_terms(phrases: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(phrases, terms)))


def lexical_text(phrases: Column, tokens: Column) -> Column:
    quoted = F.transform(phrases, lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.array_join(F.concat(quoted, F.array_except(tokens, phrase_terms(phrases))), " ")


def freshness_intent(tokens: Column, phrases: Column) -> Column:
    return F.arrays_overlap(tokens, strings(V.FRESHNESS_WORDS)) | F.arrays_overlap(
        phrases, strings(V.FRESHNESS_PHRASES)
    )


def question_like(text: Column, tokens: Column) -> Column:
    first = F.try_element_at(tokens, F.lit(1))
    return text.contains("?") | F.coalesce(F.array_contains(strings(V.QUESTION_WORDS), first), F.lit(False))


def preprocess(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add normalized_text, tokens, phrases, lexical_text, freshness_intent and question_like."""
    normalized = F.lower(quoted_query(F.col(text)))
    staged = with_nfkc(questions, text).withColumn("normalized_text", normalized)
    staged = staged.withColumn("tokens", terms(F.col("normalized_text"))).withColumn(
        "phrases", quoted_phrases(F.col("normalized_text"))
    )
    return staged.select(
        "*",
        lexical_text(F.col("phrases"), F.col("tokens")).alias("lexical_text"),
        freshness_intent(F.col("tokens"), F.col("phrases")).alias("freshness_intent"),
        question_like(F.col(text), F.col("tokens")).alias("question_like"),
    )


def metadata_terms(metadata_json: Column) -> Column:
    """Terms of the tag-like keys of a JSON object whose values are strings or arrays of strings."""
    keys = strings(V.METADATA_TERM_KEYS)
    tagged = F.map_filter(
        F.from_json(metadata_json, "map<string,variant>"), lambda k, v: F.array_contains(keys, F.lower(k))
    )

    def texts(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        items = F.try_variant_get(value, "$", "array<variant>")
        return (
            F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string")))
            .when(
                kind.startswith("ARRAY"),
                F.transform(
                    F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"),
                    lambda x: F.try_variant_get(x, "$", "string"),
                ),
            )
            .otherwise(F.array().cast("array<string>"))
        )

    found = F.flatten(F.transform(F.map_values(tagged), texts))
    all_terms = F.array_distinct(F.flatten(F.transform(found, terms)))
    return F.coalesce(all_terms, F.array().cast("array<string>"))


def significant_terms(text: Column) -> Column:
    """Terms of three or more characters outside the short stop list; repeats are kept."""
    cleaned = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]", " ")
    stop = strings(V.SIGNIFICANT_STOP_WORDS)
    return F.filter(
        F.split(cleaned, _SPACES), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)
    )


def with_terms(df: DataFrame, name: str, into: str = "terms", significant: bool = False) -> DataFrame:
    """Add the terms (or significant terms) of a column, of its Unicode compatibility form: full width letters and ligatures meet
    their plain spelling. The form is made once a text, in Python only for texts that may change."""
    staged = with_nfkc(df.withColumn(into, F.col(name)), into)
    return staged.withColumn(into, significant_terms(F.col(into)) if significant else terms(F.col(into)))


def with_safe_filename(df: DataFrame, name: str, into: str = "filename") -> DataFrame:
    """Add the storage-safe form of a file name, from its Unicode compatibility form."""
    staged = with_nfkc(df.withColumn(into, F.col(name)), into)
    return staged.withColumn(into, safe_filename(F.col(into)))


def terms_match(left: Column, right: Column) -> Column:
    long_enough = (F.length(left) >= 4) & (F.length(right) >= 4)
    return (left == right) | (long_enough & (F.startswith(left, right) | F.startswith(right, left)))


def search_text(text: Column) -> Column:
    return F.lower(collapse(text))


def slugify(name: Column, max_len: int | None = None) -> Column:
    dashed = F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+$", "")
    slug = F.coalesce(F.nullif(slug, F.lit("")), F.lit("knowledge-base"))
    return slug if max_len is None else F.substring(slug, 1, max_len)


def safe_filename(name: Column) -> Column:
    """Storage-safe file name, or null when the stem or the extension ends up empty."""
    base = F.regexp_extract(F.coalesce(F.nullif(name, F.lit("")), F.lit("document")), r"([^/]*)/*$", 1)
    extension = F.when(base == "..", "").otherwise(F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1)))
    cut = F.length(base) - F.length(extension)
    raw_stem = F.when(
        F.lower(base).endswith(extension) & base.endswith(extension), F.substring(base, F.lit(1), cut)
    ).otherwise(base)
    stem = F.regexp_replace(raw_stem, r"[\x00-\x1F\x7F]", "")
    stem = F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-")
    stem = F.regexp_replace(stem, r"-{2,}", "-")
    stem = F.substring(F.regexp_replace(stem, r"^[.-]+|[.-]+$", ""), 1, 80)
    extension = F.regexp_replace(extension, r"[^.a-z0-9]", "")
    return F.when((stem != "") & (extension != ""), F.concat(stem, extension))


def display_name(name: Column) -> Column:
    """Title for people: control characters become blanks; null when nothing is left."""
    shown = collapse(F.regexp_replace(name, r"[\x00-\x1F\x7F]", " "))
    return F.nullif(F.substring(shown, 1, 200), F.lit(""))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def conversation_title(question: Column) -> Column:
    shown = collapse(question)
    return F.when(F.length(shown) > 80, F.concat(F.substring(shown, 1, 77), F.lit("..."))).otherwise(shown)


def evidence_snippet(content: Column) -> Column:
    return F.substring(collapse(content), 1, 280)


def usage_counts(usage_json: Column) -> dict[str, Column]:
    """Five token counts from either spelling of a provider's usage object."""

    def pick(*paths: str) -> Column:
        found = [F.try_to_number(F.get_json_object(usage_json, p), F.lit("999999999999")) for p in paths]
        return F.coalesce(*found, F.lit(0)).cast("long")

    return {
        "input_tokens": pick("$.input_tokens", "$.prompt_tokens"),
        "output_tokens": pick("$.output_tokens", "$.completion_tokens"),
        "total_tokens": pick("$.total_tokens"),
        "cached_input_tokens": pick(
            "$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens"
        ),
        "reasoning_tokens": pick(
            "$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens"
        ),
    }


def eval_category(category: Column) -> Column:
    key = F.regexp_replace(F.lower(strip(F.coalesce(category, F.lit("")))), r"[^a-z0-9]+", "_")
    key = F.regexp_replace(key, r"^_+|_+$", "")
    aliases = F.create_map(*[F.lit(x) for pair in V.CATEGORY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), F.lit("general"))
