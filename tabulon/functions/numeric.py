"""Numeric helpers that avoid ANSI-mode traps and NaN leaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() accepts: optional sign, digits with optional '.', optional
# exponent, surrounding whitespace, underscores between digits, and the words
# nan / inf / infinity.  Spark's cast differs (accepts 1f / 1d, rejects 1_0),
# so the text is gated by this pattern first.
PY_FLOAT_PATTERN = (
    r"(?i)^\s*[+-]?("
    r"((\d(_?\d)*)?\.\d(_?\d)*|\d(_?\d)*\.?)(e[+-]?\d(_?\d)*)?"
    r"|nan|inf|infinity)\s*$"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite_or_null(col) -> Column:
    """NaN and +-Infinity -> NULL (SQL NULL is the only missing marker here)."""
    c = _c(col)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


PLAIN_NUMBER_CHARS = "0123456789.eE+- "


def lenient_double(col) -> Column:
    """Parse text the way Python ``float()`` would, NULL when it would raise.
    Non-finite results are NULL as well.

    Text made only of digits, '.', 'e', signs and spaces parses identically
    in Spark's cast and in Python, so it takes the cheap path (a character
    translate, no regex); anything else (suffixes like '1d', underscores,
    hex floats, words, tabs) goes through the full pattern gate."""
    c = _c(col)
    plain = F.translate(c, PLAIN_NUMBER_CHARS, "") == F.lit("")
    text = F.regexp_replace(F.trim(c), "_", "")
    value = (F.when(plain, F.trim(c).try_cast("double"))
              .when(c.rlike(PY_FLOAT_PATTERN), text.try_cast("double")))
    return finite_or_null(value)


def js_round(col) -> Column:
    """JavaScript ``Math.round``: half rounds towards +infinity."""
    return F.floor(_c(col) + F.lit(0.5))


def round_half_up(col, digits: int) -> Column:
    return F.round(_c(col), digits)


def safe_pearson(x, y) -> Column:
    """Sample Pearson r as an aggregate; NULL for n < 2 or zero variance
    (``corr`` raises DIVIDE_BY_ZERO under ANSI on constant input)."""
    xs, ys = _c(x), _c(y)
    denom = F.stddev_samp(xs) * F.stddev_samp(ys)
    return F.try_divide(F.covar_samp(xs, ys), F.when(denom != 0, denom))


def safe_pct_change(value, prev) -> Column:
    """``(value / prev - 1) * 100``; NULL when prev is NULL or 0."""
    v, p = _c(value), _c(prev)
    return F.when(p != 0, (v / p - F.lit(1.0)) * F.lit(100.0))


def mean(col, scale: int | None = None) -> Column:
    """Arithmetic mean.  With ``scale`` the sum is exact (DECIMAL(38, scale))
    and a single IEEE division follows, so the result does not depend on
    summation order across partitions; use it when inputs carry at most
    ``scale`` decimals (prices, quantities)."""
    c = _c(col)
    if scale is None:
        return F.avg(c)
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double") / F.count(c).cast("double")


def exact_sum(col, scale: int) -> Column:
    """Order-independent sum for inputs with at most ``scale`` decimals."""
    return F.sum(_c(col).cast(f"decimal(38,{scale})")).cast("double")
