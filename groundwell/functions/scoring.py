"""Score expressions for ranking, gating and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V


def clamp01(x: Column) -> Column:
    """Bound to [0, 1]; null, NaN and infinities count as 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))


def semantic_score(distance: Column) -> Column:
    return clamp01(1 - distance / 2)


def lexical_rank_norm(rank: Column) -> Column:
    return F.when(rank > 0, clamp01(rank / (rank + 1))).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def token_coverage(haystack_terms: Column, tokens: Column) -> Column:
    return share(F.size(F.array_intersect(tokens, haystack_terms)), F.size(tokens))


def phrase_coverage(haystack: Column, phrases: Column) -> Column:
    """`haystack` is lower-case with single blanks."""
    hits = F.filter(phrases, lambda p: F.contains(F.coalesce(haystack, F.lit("")), p))
    return share(F.size(hits), F.size(phrases))


def recency_score(indexed_at: Column, fresh: Column, as_of: Column) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(indexed_at)) / 86400e6)
    wanted = fresh & indexed_at.isNotNull()
    return F.when(wanted, clamp01(1 / (1 + age_days / 180))).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Both sides are arrays of distinct terms; an empty side gives 0."""
    shared = F.size(F.array_intersect(left, right))
    return share(shared, F.size(left) + F.size(right) - shared)


def term_coverage(actual: Column, expected: Column) -> Column:
    """Share of expected terms found; repeated expected terms count each time."""
    return share(F.size(F.filter(expected, lambda t: F.array_contains(actual, t))), F.size(expected))


def lexical_f1(actual: Column, expected: Column) -> Column:
    left, right = F.array_distinct(actual), F.array_distinct(expected)
    overlap = F.size(F.array_intersect(left, right))
    return share(2.0 * overlap, F.when(overlap > 0, F.size(left) + F.size(right)).otherwise(F.lit(0)))


def faq_like(section_title: Column, source_title: Column, content: Column) -> Column:
    title = F.lower(
        F.concat(F.coalesce(section_title, F.lit("")), F.lit(" "), F.coalesce(source_title, F.lit("")))
    )
    start = F.substring(F.coalesce(content, F.lit("")), 1, 120)
    return (
        title.contains("faq")
        | title.contains("frequently asked")
        | title.contains("?")
        | start.startswith("q:")
        | start.startswith("question:")
    )


def round_fixed(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def evidence_strength(top_score: Column) -> Column:
    return (
        F.when(top_score >= V.HIGH_EVIDENCE_THRESHOLD, "high")
        .when(top_score >= V.GROUNDABLE_THRESHOLD, "medium")
        .otherwise("low")
    )


def provider_backoff_ms(attempt: Column, base_ms: Column) -> Column:
    return F.least(F.lit(2000.0), base_ms * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def queue_backoff_ms(attempt: Column, base_ms: int = V.JOB_BACKOFF_MS) -> Column:
    return F.lit(base_ms) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))
