"""Predicates on nodes and edges.

A property filter's value is trimmed; a blank one is ignored.  `<`, `<=`, `>`, `>=` with a number
compare the numeric property; everything else is a case-insensitive *contains* on the text form.  A
missing property never matches.  All filters must hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that free text is looked up in, by label.
SEARCHED = {
    "Region": ("name",),
    "Nation": ("name",),
    "Customer": ("name", "segment"),
    "Supplier": ("name",),
    "Part": ("name", "brand", "ptype"),
    "Order": ("name", "status", "priority"),
    "User": ("name",),
}


def _comparison(value: str) -> tuple[str, float] | None:
    for op in ("<=", ">=", "<", ">"):
        if value.startswith(op):
            try:
                return op, float(value[len(op) :].strip())
            except ValueError:
                return None
    return None


def property_condition(key: str, value: str | None) -> Column | None:
    value = (value or "").strip()
    if not value:
        return None
    if found := _comparison(value):
        op, number = found
        have = F.try_element_at("nums", F.lit(key))
        test = {"<=": have <= number, ">=": have >= number, "<": have < number, ">": have > number}[op]
    else:
        test = F.contains(F.lower(F.try_element_at("props", F.lit(key))), F.lit(value.lower()))
    return F.coalesce(test, F.lit(False))


def merge_filters(filters: dict[str, str] | None, **shorthands: str | None) -> dict[str, str]:
    """Named shorthands override the filters map."""
    return {**(filters or {}), **{k: v for k, v in shorthands.items() if v is not None}}


def matching(df: DataFrame, filters: dict[str, str] | None = None, label: str | None = None) -> DataFrame:
    tests = [t for t in (property_condition(k, v) for k, v in (filters or {}).items()) if t is not None]
    if label and label.strip():
        tests.insert(0, F.lower("label") == label.strip().lower())
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def text_condition(text: str | None) -> Column:
    """Per label, an OR of *contains* over the properties searched for that label."""
    if not (text or "").strip():
        return F.lit(True)
    needle = F.lit(text.strip().lower())
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    out = hit(F.col("id"))
    for label, keys in SEARCHED.items():
        out = out | ((F.col("label") == label) & reduce(lambda a, b: a | b, (hit(F.try_element_at("props", F.lit(k))) for k in keys)))
    return out


def path_discovery(path: Column, prefix: str) -> Column:
    """Equal to the prefix, or below it: followed by `/` or `{`."""
    p = prefix.lower()
    return (F.lower(path) == p) | F.startswith(F.lower(path), F.lit(p + "/")) | F.startswith(F.lower(path), F.lit(p + "{"))
