"""Replaceable functions. Each takes a user callable over plain lists and applies it to Arrow batches, so the
callable sees many rows per call and Spark keeps the partitioning and the memory bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from groundwell.functions import fixed_values as V


def _packed(texts: list[str | None], items: int, tokens: int) -> Iterator[list[str]]:
    """Neighbouring texts in calls of at most `items` texts and `tokens` tokens (a token is four characters), one text at least."""
    part: list[str] = []
    held = 0
    for text in texts:
        own = max(1, -(-len(text or "") // 4))
        if part and (len(part) >= items or held + own > tokens):
            yield part
            part, held = [], 0
        part.append(text or "")
        held += own
    if part:
        yield part


def embed_texts(
    chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, batch_items: int = V.EMBED_BATCH_ITEMS,
    text: str = "content", batch_tokens: int = V.EMBED_BATCH_TOKENS,
) -> DataFrame:
    """Add embedding, embedding_model, embedding_dim and embedding_error; `embed` gets at most `batch_items` texts and
    `batch_tokens` tokens per call. A call that fails or returns too few vectors, or an empty one, leaves nulls and an error
    code on its rows; other calls go on."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("embedding_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for part in _packed(texts, batch_items, batch_tokens):
                try:
                    found = embed(part)
                except Exception:  # a provider may raise anything; the rows of this call carry the failure
                    found = []
                if len(found) != len(part):
                    vectors += [None] * len(part)
                    errors += ["OPENAI_EMBEDDING_FAILED"] * len(part)
                    continue
                vectors += [v or None for v in found]
                errors += [None if v else "OPENAI_RESPONSE_EMPTY" for v in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=[*batch.schema.names, "embedding", "embedding_error"],
            )

    return chunks.mapInArrow(run, schema).withColumn(
        "embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model))
    ).withColumn("embedding_dim", F.size("embedding"))


def answer_prompts(prompts: DataFrame, answer: Callable[[list[str]], list[str]], prompt: str = "prompt", batch_items: int = 32) -> DataFrame:
    """Add `answer_json`, the callable's JSON text per prompt, and `answer_error`. The text is validated as a column afterwards.
    A call that fails, or whose answers do not number its prompts, leaves a null and an error code on its rows."""
    schema = StructType([*prompts.schema.fields, StructField("answer_json", StringType()), StructField("answer_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
            answers: list[str | None] = []
            errors: list[str | None] = []
            for begin in range(0, len(texts), batch_items):
                part = texts[begin : begin + batch_items]
                try:
                    said = answer(part)
                    failed = None if len(said) == len(part) else "OPENAI_CHAT_FAILED"
                except Exception:
                    said, failed = [], "OPENAI_CHAT_FAILED"
                answers += said if failed is None else [None] * len(part)
                errors += [failed] * len(part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "answer_json", "answer_error"]
            )

    return prompts.mapInArrow(run, schema)


def parse_files(files: DataFrame, parse: Callable[[bytes], list[tuple[int | None, str]]]) -> DataFrame:
    """Lines (doc_id, page_number, line_no, text, error_code) of binary files; `parse` returns (page, line) pairs. A file that
    cannot be parsed is one row without a line, with an error code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            contents = batch.column(batch.schema.get_field_index("content")).to_pylist()
            for doc_id, content in zip(ids, contents):
                try:
                    lines = [(page, n, text, None) for n, (page, text) in enumerate(parse(content), 1)]
                except Exception:
                    lines = [(None, None, None, "FILE_PARSE_FAILED")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id] * len(lines), pa.int64()),
                    "page_number": pa.array([x[0] for x in lines], pa.int32()),
                    "line_no": pa.array([x[1] for x in lines], pa.int32()),
                    "text": pa.array([x[2] for x in lines], pa.string()),
                    "error_code": pa.array([x[3] for x in lines], pa.string()),
                })

    return files.select("doc_id", "content").mapInArrow(
        run, "doc_id bigint, page_number int, line_no int, text string, error_code string"
    )
