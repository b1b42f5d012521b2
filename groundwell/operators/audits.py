"""Table-quality audits and redaction. Every audit is one pass that counts or lists violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import fixed_values as V
from groundwell.functions import text as T


def rule_counts(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule, counted in a single scan. A rule is the condition
    that must hold; unknown (null) passes, as a database check would let it."""
    counts = table.agg(*[F.count_if(~hold).alias(name) for name, hold in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def nonblank(*names: str) -> dict[str, Column]:
    return {f"{n}_blank": F.length(F.trim(F.col(n))) > 0 for n in names}


def embedding_consistent() -> Column:
    vector, model, dim = F.col("embedding"), F.col("embedding_model"), F.col("embedding_dim")
    none = vector.isNull() & model.isNull() & dim.isNull()
    whole = vector.isNotNull() & model.isNotNull() & dim.isNotNull() & (dim > 0) & (F.size(vector) == dim)
    return none | F.coalesce(whole, F.lit(False))


def json_object(text: Column) -> Column:
    """True for null and for text that parses as a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return text.isNull() | F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def in_domain(column: Column, domain: list[str]) -> Column:
    return column.isNull() | column.isin(domain)


def duplicates(table: DataFrame, keys: list[Column]) -> DataFrame:
    """Key values held by more than one row."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose (composite) key has no parent row; keys holding a null are not checked."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return child.filter(complete).join(parent.select(*keys).distinct(), keys, "left_anti")


def delete_restricted(requested: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents requested for deletion that still have children."""
    return requested.join(children.select(key).distinct(), key, "left_semi")


_TRUNCATED = "[truncated]"


#: levels of JSON that are looked into; what lies deeper is replaced, never printed
_LEVELS = 6


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _quoted(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)


def _object(value: Column, entry) -> Column:
    """JSON text of an object whose entries are given by `entry`."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, entry), ","), F.lit("}"))


def _list(items: Column, item) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, item), ","), F.lit("]"))


def audit_sanitize(payload: Column) -> Column:
    """JSON payload with sensitive keys redacted, strings cut to 200 characters, every list to 20 items, and
    objects below the second level replaced; objects and lists both count as levels."""
    keys = T.strings(V.AUDIT_REDACTED_KEYS)

    def scalar(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)
        return F.when(_kind(value) == "STRING", _quoted(cut)).otherwise(F.to_json(value))

    def clean(value: Column, depth: int) -> Column:
        gone = _quoted(F.lit(_TRUNCATED))

        def entry(e: Column) -> Column:
            hidden = F.array_contains(keys, F.lower(e["key"]))
            shown = F.when(hidden, _quoted(F.lit("[redacted]"))).otherwise(clean(e["value"], depth + 1))
            return F.concat(_quoted(e["key"]), F.lit(":"), shown)

        whole = gone if depth >= 2 else _object(value, entry)
        first = F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, 20)
        listed = gone if depth >= _LEVELS else _list(first, lambda x: clean(x, depth + 1))
        return F.when(_kind(value).startswith("OBJECT"), whole).when(_kind(value).startswith("ARRAY"), listed).otherwise(scalar(value))

    top = F.try_parse_json(payload)
    return F.when(F.coalesce(_kind(top).startswith("OBJECT"), F.lit(False)), clean(top, 0)).otherwise("{}")


def snake_case(key: Column) -> Column:
    split = F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"[-\s]+", "_"))


def log_redact(record: Column) -> Column:
    """JSON log record as a map: keys in snake case, values of sensitive keys hidden at every level, in lists too.
    A nested value is its JSON text, with keys in the order of their names."""
    hidden = F.lit("[REDACTED]")

    def sensitive(key: Column) -> Column:
        return key.rlike(V.LOG_SENSITIVE_PATTERN)

    def clean(value: Column, depth: int) -> Column:
        if depth >= _LEVELS:
            return F.when(_kind(value).rlike("^(OBJECT|ARRAY)"), _quoted(hidden)).otherwise(F.to_json(value))

        def entry(e: Column) -> Column:
            shown = F.when(sensitive(e["key"]), _quoted(hidden)).otherwise(clean(e["value"], depth + 1))
            return F.concat(_quoted(snake_case(e["key"])), F.lit(":"), shown)

        listed = _list(F.try_variant_get(value, "$", "array<variant>"), lambda x: clean(x, depth + 1))
        return (
            F.when(_kind(value).startswith("OBJECT"), _object(value, entry)).when(_kind(value).startswith("ARRAY"), listed)
            .otherwise(F.to_json(value))
        )

    def top(value: Column) -> Column:
        nested = _kind(value).rlike("^(OBJECT|ARRAY)")
        return F.when(nested, clean(value, 1)).otherwise(F.try_variant_get(value, "$", "string"))

    entries = F.transform(
        F.map_entries(F.try_variant_get(F.try_parse_json(record), "$", "map<string,variant>")),
        lambda e: F.struct(
            snake_case(e["key"]).alias("key"), F.when(sensitive(e["key"]), hidden).otherwise(top(e["value"])).alias("value")
        ),
    )
    return F.map_from_entries(entries)


def correlation_valid(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._:-]{1,128}$"), F.lit(False))
