"""Every registered query, by family."""

from importlib import import_module

FAMILIES = [
    "retrieval_queries", "function_queries", "entity_queries", "ingest_queries", "ops_queries",
    "answer_queries", "eval_queries", "stream_queries", "rule_queries",
]


def load():
    """Import all families and return the registry."""
    for family in FAMILIES:
        import_module(f"groundwell.conformance.{family}")
    return import_module("groundwell.conformance.registry")
