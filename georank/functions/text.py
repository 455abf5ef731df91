"""String, path and filter-rule helpers of catalog selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def alias_key(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def sanitize_filename(x: Column) -> Column:
    """Runs of other characters than A-Z a-z 0-9 _ . - become _, outer _ go; nothing left gives ``item``."""
    clean = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "item").otherwise(clean)


def item_date(stamp: Column, seq: Column) -> Column:
    """The first ten characters of a time stamp, or item-N."""
    return F.coalesce(F.when(F.length(stamp) > 0, F.substring(stamp, 1, 10)), F.concat(F.lit("item-"), seq.cast("string")))


def strip_file_scheme(x: Column) -> Column:
    return F.regexp_replace(x, "^file://", "")


def property_value(json: Column, path: str, kind: str = "string") -> Column:
    """A property of a JSON text by name or dotted path; null where it is missing or of another type."""
    steps = [p for p in path.split(".")] if path.startswith("properties.") else [path]
    if steps[0] == "properties":
        steps = steps[1:]
    quoted = "$" + "".join(f'["{p}"]' for p in steps)
    return F.try_variant_get(F.try_parse_json(json), quoted, kind)


def property_kind(json: Column, path: str) -> Column:
    """The type of a property: STRING, BOOLEAN, a numeric type or another; null where it is missing."""
    return F.schema_of_variant(property_value(json, path, "variant"))


def _same(value: Column, number: Column, kind: Column | None, literal) -> Column:
    """Equality by type: a text equals texts only; numbers and booleans equal each other by value, 1, 1.0 and true alike."""
    is_text = F.lit(True) if kind is None else kind == "STRING"
    if isinstance(literal, str):
        return F.coalesce(is_text & (value == F.lit(literal)), F.lit(False))
    truth = F.when(value == "true", 1.0).when(value == "false", 0.0)
    known = number if kind is None else F.when(kind == "BOOLEAN", truth).when(kind != "STRING", number)
    return F.coalesce(known == F.lit(float(literal)), F.lit(False))


def rule(value: Column, number: Column, eq=None, ne=None, lte=None, gte=None, contains=None, kind: Column | None = None) -> Column:
    """A filter rule's predicate, never null: every given operator must hold; null passes ne alone.

    value and number are the property as text and as double; kind is its type, without which texts are taken for texts.
    """
    tests = []
    if eq is not None:
        tests.append(_same(value, number, kind, eq))
    if ne is not None:
        tests.append(~_same(value, number, kind, ne))
    if lte is not None:
        tests.append(F.coalesce(number <= float(lte), F.lit(False)))
    if gte is not None:
        tests.append(F.coalesce(number >= float(gte), F.lit(False)))
    if contains is not None:
        tests.append(F.coalesce(F.contains(value, F.lit(contains)), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def zone_name(name: Column, index: Column) -> Column:
    """A non-blank name, trimmed, or red-zone-N by place among all features."""
    trimmed = F.trim(name)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.concat(F.lit("red-zone-"), (index + 1).cast("string")))


def category_allowed(category: Column, include=(), exclude=()) -> Column:
    key = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    ok = key.isin(*[c.strip().lower() for c in include]) if include else F.lit(True)
    return ok & ~key.isin(*[c.strip().lower() for c in exclude]) if exclude else ok


def dissolve_key(mode: str, name: Column, category: Column, index: Column) -> Column:
    if mode == "name":
        return F.concat(F.lit("name::"), name)
    if mode == "category":
        return F.concat(F.lit("category::"), F.coalesce(category, F.lit("(uncategorized)")))
    return F.lit("all") if mode == "all" else F.concat(F.lit("none::"), index.cast("string"))
