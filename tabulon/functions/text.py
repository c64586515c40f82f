"""String helpers matching Python ``str`` semantics on Spark columns.

Java's ``\\s`` and ``\\w`` are ASCII-only; the ``(?U)`` flag makes them
Unicode-aware, which is what Python's ``str.split``/``re`` use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_EDGES = r"(?U)^\s+|\s+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: cuts Unicode whitespace (tabs, newlines too) at both ends."""
    return F.regexp_replace(_c(col), _WS_EDGES, "")


def blank_to_empty(col) -> Column:
    """``(x or "").strip()``: NULL -> '' and trimmed."""
    return F.coalesce(py_strip(col), F.lit(""))


def nonblank(col) -> Column:
    return blank_to_empty(col) != F.lit("")


def py_tokens(col) -> Column:
    """``str.split()`` with no argument: split on runs of whitespace, no empties."""
    return F.filter(F.split(py_strip(col), r"(?U)\s+"), lambda t: t != F.lit(""))


def slug(col) -> Column:
    """lower-case, runs of non-word characters -> '-', trimmed of '-'."""
    dashed = F.regexp_replace(F.lower(_c(col)), r"(?U)[^\w]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def ordered_ci_union(items: Column) -> Column:
    """Fold an array of strings into its ordered, case-insensitive distinct
    list: items trimmed, blanks dropped, first spelling wins."""
    cleaned = F.filter(F.transform(items, lambda x: py_strip(x)), lambda x: x != F.lit(""))
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc)
        .otherwise(F.array_append(acc, x)),
    )
