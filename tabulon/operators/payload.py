"""Whole chat payloads as JSON, checked value by value.

The payload is parsed once into a VARIANT, so the type a value was written
with is visible, and every list is checked element by element as an array of
VARIANT inside the row: a request's lists are bounded by the rules themselves
(anything longer is rejected by its size first).  The rules and their order
are the reference's; the first one that fails is the reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import py_strip
from tabulon.operators import dialog as D

# Fixed values that must equal the reference's for identical results.
INDICATOR_FIELDS = ("id", "label", "unit", "description", "source", "source_note")
INDICATOR_FIELD_CHARS = 240
LABEL_CHARS = 120
INTEGER_FILTERS = ("year", "top_n", "rank_start", "rank_end")
# end of fixed values


def _at(v: Column, key: str) -> Column:
    """The value of a key: SQL NULL where the key is absent."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    """The type a value was written with (NULL without a value)."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _given(v: Column) -> Column:
    """There and not null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_number(v: Column) -> Column:
    finite = F.abs(F.try_variant_get(v, "$", "double")) < float("inf")
    return _kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT") & finite


def _is_integer(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _bounded_text(v: Column, most: int) -> Column:
    """A string that has 1 to ``most`` characters without the space around it."""
    body = py_strip(_text(v))
    return _is_text(v) & (body != "") & (F.char_length(body) <= most)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(v: Column, key: str) -> tuple[Column, Column]:
    """Whether a key holds a list (or is absent), and its elements."""
    value = _at(v, key)
    items = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    return value.isNull() | _yes(_kind(value) == "ARRAY"), items


def _every(items: Column, rule: Callable[[Column], Column]) -> Column:
    return F.forall(items, lambda x: _yes(rule(x)))


def record_ok(r: Column) -> Column:
    """N20 on one VARIANT: an object with a known key, names of at most 120 characters, finite numbers."""
    checks, known = [], []
    for key in D.RECORD_KEYS:
        value = _at(r, key)
        fine = _is_text(value) & (F.char_length(_text(value)) <= D.RECORD_NAME_CHARS) if key in D.RECORD_NAME_KEYS else _is_number(value)
        known.append(value.isNotNull())
        checks.append(value.isNull() | _yes(fine))
    some, good = known[0], checks[0]
    for k, c in zip(known[1:], checks[1:]):
        some, good = some | k, good & c
    return (_kind(r) == "OBJECT") & some & good


def _indicator_ok(x: Column, registry: Column) -> Column:
    ok = _kind(x) == "OBJECT"
    for field in INDICATOR_FIELDS:
        value = _at(x, field)
        ok = ok & (~_given(value) | _yes(_is_text(value) & (F.char_length(_text(value)) <= INDICATOR_FIELD_CHARS)))
    named = _yes(F.char_length(_text(_at(x, "label"))) > 0)
    return ok & named & F.array_contains(registry, F.coalesce(_text(_at(x, "id")), F.lit("")))


def _statistic_ok(x: Column) -> Column:
    value = _at(x, "value")
    return (_kind(x) == "OBJECT") & _bounded_text(_at(x, "label"), LABEL_CHARS) & (_is_text(value) | _is_number(value))


def _history_ok(x: Column) -> Column:
    role = _at(x, "role")
    return (_kind(x) == "OBJECT") & _is_text(role) & _text(role).isin(*D.ROLES) & _bounded_text(_at(x, "content"), D.REQUEST_MESSAGE_CHARS)


def _country_ok(x: Column) -> Column:
    return _is_text(x) & F.upper(_text(x)).rlike(D.COUNTRY_CODE_PATTERN)


def payload_check(requests: DataFrame, registry_ids: list[str], payload: str = "payload") -> DataFrame:
    """``requests`` with ``reason``, the first failing rule (NULL when valid), ``valid``, and the sizes
    ``n_rows``, ``n_points``, ``n_statistics`` of the snapshot's lists.  Text that is no JSON object fails ``payload``."""
    v = F.col("_v")
    registry = F.array(*[F.lit(i) for i in registry_ids])
    mode, filters, snapshot = _at(v, "mode"), _at(v, "filters"), _at(v, "snapshot")
    shape_i, indicators = _list(v, "indicators")
    ids = F.transform(indicators, lambda x: _text(_at(x, "id")))
    shape_c, countries = _list(filters, "countries")
    (shape_r, rows), (shape_p, points), (shape_s, statistics) = (_list(snapshot, k) for k in ("rows", "points", "statistics"))
    shape_h, history = _list(v, "history")
    expected = F.when(_text(mode) == "correlation", 2).otherwise(1)
    integers = F.lit(True)
    for field in INTEGER_FILTERS:
        value = _at(filters, field)
        small = F.abs(F.try_variant_get(value, "$", "double")) <= D.REQUEST_MAX_INT
        integers = integers & (~_given(value) | _yes(_is_integer(value) & small))
    order = _at(filters, "order")

    def object_or_absent(x: Column) -> Column:
        return x.isNull() | (_kind(x) == "OBJECT")

    rules = [
        ("payload", _kind(v) == "OBJECT"),
        ("message", _bounded_text(_at(v, "message"), D.REQUEST_MESSAGE_CHARS)),
        ("mode", _is_text(mode) & _text(mode).isin(*D.MODES)),
        ("indicators", shape_i & (F.size(indicators) <= D.REQUEST_MAX_INDICATORS) & _every(indicators, lambda x: _indicator_ok(x, registry))),
        ("indicator_count", (F.size(indicators) == expected) & (F.size(F.array_distinct(ids)) == F.size(ids))),
        ("countries", object_or_absent(filters) & shape_c & (F.size(countries) <= D.REQUEST_MAX_COUNTRIES) & _every(countries, _country_ok)),
        ("integers", integers),
        ("order", ~_given(order) | _yes(_is_text(order) & _text(order).isin("asc", "desc"))),
        ("snapshot", object_or_absent(snapshot) & shape_r & shape_p & shape_s & (F.size(rows) <= D.REQUEST_MAX_ROWS)
         & (F.size(points) <= D.REQUEST_MAX_POINTS) & (F.size(statistics) <= D.REQUEST_MAX_STATISTICS)),
        ("rows", _every(rows, record_ok)),
        ("points", _every(points, record_ok)),
        ("statistics", _every(statistics, _statistic_ok)),
        ("history", shape_h & (F.size(history) <= D.REQUEST_MAX_HISTORY) & _every(history, _history_ok)),
    ]
    reason = F.coalesce(*[F.when(~_yes(ok), F.lit(name)) for name, ok in rules])
    sizes = {f"n_{n}": F.size(x).cast("bigint") for n, x in (("rows", rows), ("points", points), ("statistics", statistics))}
    return requests.withColumn("_v", F.try_parse_json(F.col(payload))).withColumns({"reason": reason, **sizes}) \
        .withColumn("valid", F.col("reason").isNull()).drop("_v")
