"""The write path: documents or page lines to chunks, in one lazy plan with one exchange by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.operators import blocks as B
from groundwell.operators import chunks as C
from groundwell.operators import normalize as N


def text_lines(docs: DataFrame) -> DataFrame:
    """Lines of plain-text documents (doc_id, text); they have no pages."""
    return B.split_lines(docs.select("doc_id", "text")).withColumn("page_number", F.lit(None).cast("int"))


def ingest_lines(
    lines: DataFrame, target: int = V.CHUNK_TARGET_TOKENS, overlap: int = V.CHUNK_OVERLAP_TOKENS
) -> DataFrame:
    normalized = N.normalize_blocks(B.lines_to_blocks(lines, nfkc=True))
    return C.chunk_documents(N.indexable_blocks(normalized), target, overlap)


def ingest_documents(
    docs: DataFrame, target: int = V.CHUNK_TARGET_TOKENS, overlap: int = V.CHUNK_OVERLAP_TOKENS
) -> DataFrame:
    return ingest_lines(text_lines(docs), target, overlap)


def rejected_documents(docs: DataFrame) -> DataFrame:
    """Documents that end in an error, with its code; one bad document never fails the job."""
    found = B.lines_to_blocks(text_lines(docs), nfkc=True)
    empty = B.empty_documents(docs.select("doc_id"), found)
    poor = N.quality_gate(N.normalize_blocks(found)).filter("error_code IS NOT NULL").select("doc_id", "error_code")
    return empty.unionByName(poor)
