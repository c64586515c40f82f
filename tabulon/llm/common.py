"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import checkpoint_dir

# Word separators of every operator here: space and the controls 0x09-0x0D.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (a lambda variable, which the
    optimizer never inlines into an inner loop)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, in order."""
    core = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(core == F.lit(""), F.array().cast("array<string>")).otherwise(
        F.split(core, f"[{SPACE_CLASS}]+"))


def count_of(text: Column, char_class: str) -> Column:
    """Number of characters of a regex character class (given without brackets)."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def clear_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage and survives
    the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

