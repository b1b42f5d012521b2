"""The rules of the data model as data, and their counts: one aggregate a table, one grouping a key, one anti-join a reference."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.operators import audits as A


@dataclass(frozen=True)
class Rules:
    """What holds for the rows of one table. `ranges` are SQL conditions by name; `required` JSON columns may not be null;
    `unique` keys are lists of SQL expressions, counted among rows where `unique_where` holds; `references` name a parent table and
    the columns both sides share."""

    ranges: dict[str, str] = field(default_factory=dict)
    nonblank: tuple[str, ...] = ()
    json_objects: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    domains: dict[str, list[str]] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)
    unique_where: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    vectors: bool = False


CATALOGUE = {
    "knowledge_base": Rules(domains={"status": V.KB_STATUSES}, unique={"slug": ["lower(slug)"]}),
    "user": Rules(unique={"email": ["lower(email)"]}),
    "member": Rules(unique={"member": ["kb_id", "user_id"]}),
    "document": Rules(domains={"status": V.DOCUMENT_STATUSES}, unique={"document_kb": ["doc_id", "kb_id"]}),
    "version": Rules(
        ranges={"version_number": "version_number > 0", "ingest_version": "ingest_version > 0", "chunk_count": "chunk_count >= 0"},
        domains={"status": V.VERSION_STATUSES, "vectorization_status": V.VECTOR_STATUSES},
        unique={"version_number": ["doc_id", "version_number"], "version_document": ["version_id", "doc_id"]},
        references={"document": ("document", ["doc_id"])},
    ),
    "job": Rules(
        ranges={"attempts": "attempts >= 0", "max_attempts": "max_attempts > 0", "attempts_lte_max": "attempts <= max_attempts"},
        domains={"status": V.JOB_STATUSES}, references={"version": ("version", ["version_id"])},
    ),
    "chunk": Rules(
        ranges={"chunk_no": "chunk_no > 0", "token_count": "token_count > 0"},
        nonblank=("chunking_strategy", "chunking_version", "checksum"), json_objects=("metadata_json",), vectors=True,
        unique={"live_chunk": ["version_id", "chunk_no"], "chunk_document": ["chunk_id", "doc_id"]},
        unique_where={"live_chunk": "superseded_at IS NULL"},
        references={"document_kb": ("document", ["doc_id", "kb_id"]), "version_document": ("version", ["version_id", "doc_id"])},
    ),
    "message": Rules(json_objects=("usage_json", "retrieval_meta_json")),
    "citation": Rules(unique={"citation": ["message_id", "chunk_id"]}, references={"chunk_document": ("chunk", ["chunk_id", "doc_id"])}),
    "eval_run": Rules(json_objects=("retrieval_config_json", "summary_json"), required=("retrieval_config_json",), references={"set_kb": ("eval_set", ["eval_set_id", "kb_id"])}),
    "eval_item": Rules(json_objects=("retrieved_sources_json", "usage_json"), required=("retrieved_sources_json",), unique={"item": ["eval_run_id", "eval_case_id"]}),
}


def row_rules(rules: Rules) -> dict[str, Column]:
    """Conditions that one row decides, by kind and name."""
    out = {f"range:{name}": F.expr(condition) for name, condition in rules.ranges.items()}
    out |= {f"nonblank:{name}": F.length(F.trim(F.col(name))) > 0 for name in rules.nonblank}
    for name in rules.json_objects:
        held = A.json_object(F.col(name))
        out[f"json:{name}"] = held & F.col(name).isNotNull() if name in rules.required else held
    out |= {f"domain:{name}": A.in_domain(F.col(name), values) for name, values in rules.domains.items()}
    if rules.vectors:
        out["vector:embedding"] = A.embedding_consistent()
    return out


def check_table(name: str, tables: dict[str, DataFrame], catalogue: dict[str, Rules] = CATALOGUE) -> DataFrame:
    """(table_name, rule, violations) for every rule of a table. Row rules are one aggregate of one scan. A key counts its values that
    several rows hold, a reference the rows without a parent; both shuffle the key columns only."""
    rules, table = catalogue[name], tables[name]
    found = []
    rows = row_rules(rules)
    if rows:
        found.append(A.rule_counts(table, rows))
    for key, columns in rules.unique.items():
        held = table.filter(rules.unique_where[key]) if key in rules.unique_where else table
        keys = [F.expr(c).alias(f"k{i}") for i, c in enumerate(columns)]
        whole = reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(columns))])
        twice = A.duplicates(held.select(*keys).filter(whole), [F.col(f"k{i}") for i in range(len(columns))])
        found.append(twice.agg(F.count("*").alias("violations")).select(F.lit(f"unique:{key}").alias("rule"), "violations"))
    for key, (parent, columns) in rules.references.items():
        lost = A.orphans(table.select(*columns), tables[parent], columns)
        found.append(lost.agg(F.count("*").alias("violations")).select(F.lit(f"reference:{key}").alias("rule"), "violations"))
    every = reduce(DataFrame.unionByName, found)
    return every.select(F.lit(name).alias("table_name"), "rule", "violations")


def check_all(tables: dict[str, DataFrame], kinds: tuple[str, ...] = (), catalogue: dict[str, Rules] = CATALOGUE) -> DataFrame:
    """Counts of all tables that are given, of rules of the given kinds (all without)."""
    every = reduce(DataFrame.unionByName, [check_table(name, tables, catalogue) for name in catalogue if name in tables])
    return every.filter(F.substring_index("rule", ":", 1).isin(*kinds)) if kinds else every
