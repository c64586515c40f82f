"""Indicator-panel operators: filters, rankings, year-over-year change,
country means, correlation, summaries and lookups.

The panel is one long table for every indicator::

    country_code string, country_name string, year int,
    indicator_id string, value double, source string

Operators work on all indicators (and years) at once; windows are always
partitioned by ``indicator_id`` (plus year or country), so no window ever
collapses to a single partition.  A stored panel should be partitioned by
``indicator_id`` so a per-indicator filter prunes files.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import mean, safe_pct_change, safe_pearson

PANEL_COLUMNS = ("country_code", "country_name", "year", "indicator_id", "value", "source")
PANEL_SCHEMA = ("country_code string, country_name string, year int, indicator_id string, "
                "value double, source string")

MAX_RANK = 1000
COUNTRY_CODE_RE = re.compile(r"[A-Z0-9_-]{1,12}\Z")


def clean_codes(codes) -> list[str]:
    """U2 on a parameter list: upper-cased, trimmed, ordered-distinct country
    codes (driver side; the column form is ``array_distinct`` in
    ``dialog.action_check``)."""
    out: list[str] = []
    for c in codes or []:
        c = str(c).strip().upper()
        if c and c not in out:
            out.append(c)
    return out


# --------------------------------------------------------------------- filters

def filter_panel(panel: DataFrame, countries=None, year_min: int | None = None,
                 year_max: int | None = None) -> DataFrame:
    """empty/None country list means no country filter; bounds inclusive.

    A Python list becomes an ``In`` predicate pushed to the Parquet scan; a
    DataFrame of codes (any size) becomes a ``left_semi`` join."""
    out = panel
    if isinstance(countries, DataFrame):
        out = out.join(countries.select("country_code").distinct(), "country_code", "left_semi")
    elif countries:
        out = out.where(F.col("country_code").isin(clean_codes(countries)))
    if year_min is not None:
        out = out.where(F.col("year") >= int(year_min))
    if year_max is not None:
        out = out.where(F.col("year") <= int(year_max))
    return out


def region_filter(panel: DataFrame, bridge: DataFrame, region: str) -> DataFrame:
    """rows of the member countries of one region group."""
    members = bridge.where(F.col("region") == region).select("country_code")
    return panel.join(members, "country_code", "left_semi")


def year_slice(panel: DataFrame, year: int) -> DataFrame:
    """F6."""
    return panel.where(F.col("year") == int(year))


def record_projection(panel: DataFrame) -> DataFrame:
    """the four display columns with hard casts."""
    return panel.select(
        F.col("country_code").cast("string").alias("country_code"),
        F.col("country_name").cast("string").alias("country_name"),
        F.col("year").cast("int").alias("year"),
        F.col("value").cast("double").alias("value"),
    )


def country_list(panel: DataFrame) -> DataFrame:
    """Distinct countries; order by name when displayed."""
    return panel.select("country_code", "country_name").distinct()


# --------------------------------------------------------------------- windows

def rank_bounds(top_n: int = 10, rank_start: int | None = None,
                rank_end: int | None = None) -> tuple[int, int]:
    """W2 defaults: start 1 (0/None = not given), end = start + top_n - 1;
    1 <= start <= end <= 1000."""
    if top_n is None or int(top_n) < 1:
        raise ValueError("top_n must be a positive integer")
    start = int(rank_start) if rank_start else 1
    end = int(rank_end) if rank_end else start + int(top_n) - 1
    if start < 1 or end < start or end > MAX_RANK:
        raise ValueError(f"rank range must satisfy 1 <= start <= end <= {MAX_RANK}")
    return start, end


def rankings(panel: DataFrame, year: int | None = None, top_n: int = 10,
             ascending: bool = False, rank_start: int | None = None,
             rank_end: int | None = None, countries=None) -> DataFrame:
    """Positional rank per (indicator_id, year); missing values last in
    both directions; ties broken by country code.  Only ranks in
    [rank_start, rank_end] are kept, so Spark inserts a WindowGroupLimit
    below the window (per-partition top-k before the shuffle)."""
    start, end = rank_bounds(top_n, rank_start, rank_end)
    df = panel if year is None else year_slice(panel, year)
    if countries:
        df = filter_panel(df, countries)
    value_order = F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()
    w = Window.partitionBy("indicator_id", "year").orderBy(
        value_order, F.col("country_code").asc(), F.col("source").asc())
    return (df.withColumn("rank", F.row_number().over(w))
              .where(F.col("rank") <= end)
              .where(F.col("rank") >= start)
              .withColumn("rank", F.col("rank").cast("bigint")))


def year_over_year(panel: DataFrame) -> DataFrame:
    """Change against the previous *row* of the same country (gaps in
    years are bridged, as in the reference); percent change is NULL when the
    previous value is 0 or missing."""
    w = Window.partitionBy("indicator_id", "country_code").orderBy("year", "source", "value")
    prev = F.lag("value").over(w)
    return (panel.withColumn("prev_value", prev)
                 .withColumn("change", F.col("value") - F.col("prev_value"))
                 .withColumn("pct_change", safe_pct_change("value", "prev_value"))
                 .drop("prev_value"))


# ----------------------------------------------------------------- aggregates

def country_means(panel: DataFrame, mean_scale: int | None = None) -> DataFrame:
    """A1: mean per (indicator, country) over the country's own years."""
    return (panel.groupBy("indicator_id", "country_code", "country_name")
                 .agg(mean("value", mean_scale).alias("value")))


def pair_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two indicators' rows on country_code; values are
    suffixed ``_a``/``_b``, the name comes from the left side."""
    left = a.select("country_code", "country_name", F.col("value").alias("value_a"))
    right = b.select("country_code", F.col("value").alias("value_b"))
    return left.join(right, "country_code", "inner")


def correlate(panel: DataFrame, id_a: str, id_b: str, year: int | None = None):
    """A2/A3 for one pair.  Returns ``(summary, points)``: summary has one row
    (n, correlation rounded to 4); points is empty when n < 2."""
    a = panel.where(F.col("indicator_id") == id_a)
    b = panel.where(F.col("indicator_id") == id_b)
    if year is not None:
        a, b = year_slice(a, year), year_slice(b, year)
    else:
        a, b = country_means(a), country_means(b)
    merged = pair_join(a, b)
    summary = merged.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(safe_pearson("value_a", "value_b"), 4).alias("correlation"),
    )
    points = (merged.where(summary.select("n").scalar() >= 2)
              .select("country_code", "country_name",
                      F.col("value_a").alias("x"), F.col("value_b").alias("y")))
    return summary, points


# Indicators of one block (tile) of the pair table, and parts the countries of a tile are dealt over.
PAIR_BLOCK = 512
TILE_PARTS = 16
# Values of countries that a task multiplies together.
TILE_ROWS = 200_000


def _tile_sums(tile: int):
    """Rows sorted by (low, high, country_code): sums of products over the countries of a task for every pair of
    a tile.  A country's values are one row of a matrix, so a pair costs two multiplications a country."""
    def run(batches):
        def add(total, pdf: pd.DataFrame, low: int, high: int):
            countries, at = np.unique(pdf["country_code"].to_numpy(), return_inverse=True)
            sides = []
            for t in (low, high):
                own = (pdf["number"] // tile == t).to_numpy()
                x, m = np.zeros((len(countries), tile)), np.zeros((len(countries), tile))
                cell = at[own], (pdf["number"][own] % tile).to_numpy()
                x[cell], m[cell] = pdf["value"][own], 1.0
                sides.append((x, m))
            (x, mx), (y, my) = sides
            parts = (mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
            return parts if total is None else tuple(p + q for p, q in zip(total, parts))

        def rows(total, low: int, high: int) -> pd.DataFrame:
            a, b = np.nonzero(total[0])
            pair = low * tile + a < high * tile + b
            a, b = a[pair], b[pair]
            return pd.DataFrame({"a": low * tile + a, "b": high * tile + b,
                                 **{n: p[a, b] for n, p in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), total)}})

        total, key, held = None, None, []
        for pdf in batches:
            for now, part in pdf.groupby(["low", "high"], sort=False):
                if now != key:
                    if held:
                        total = add(total, pd.concat(held), *key)
                    if total is not None:
                        yield rows(total, *key)
                    total, key, held = None, now, []
                held.append(part)
                if sum(map(len, held)) > TILE_ROWS:
                    # whole countries only: the last one may go on in the next batch
                    every = pd.concat(held)
                    last = (every["country_code"] == every["country_code"].iloc[-1]).to_numpy()
                    if not last.all():
                        total = add(total, every[~last], *key)
                        held = [every[last]]
        if held:
            total = add(total, pd.concat(held), *key)
        if total is not None:
            yield rows(total, *key)
    return run


def correlate_all_pairs(panel: DataFrame, year: int | None = None,
                        indicator_ids: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """A2 re-aimed: Pearson r for every unordered indicator pair at once.

    No pair rows of values are formed: the panel is reduced to one mean per
    (country, indicator), less the indicator's own mean, and the pair sums
    are products of matrices (countries x indicators, with a mask for
    missing values) that tasks add up over their countries.  The pair table
    is cut into tiles of ``tile`` (``PAIR_BLOCK``) x ``tile`` indicators, so a task holds a few
    matrices of that size for any number of indicators; a value is sent once
    for each tile it belongs to (one up to ``tile`` indicators).  Indicator
    ids come from the registry, or from the distinct ids present (a dimension,
    collected).  ``n`` counts the countries with both; r is NULL below two or
    without variance."""
    tile = tile or PAIR_BLOCK
    base = year_slice(panel, year) if year is not None else panel
    if indicator_ids is None:
        indicator_ids = [r[0] for r in base.select("indicator_id").distinct().collect() if r[0] is not None]
    ids = sorted(set(indicator_ids))
    spark = panel.sparkSession
    if len(ids) < 2:
        return spark.createDataFrame([], "indicator_a string, indicator_b string, n bigint, correlation double")
    numbers = spark.createDataFrame(list(enumerate(ids)), "number int, indicator_id string")
    means = (base.join(numbers, "indicator_id").groupBy("country_code", "number")
                 .agg(F.avg("value").alias("value")).where(F.col("value").isNotNull()))
    center = means.groupBy("number").agg(F.avg("value").alias("center"))
    tiles = (len(ids) + tile - 1) // tile
    own = F.floor(F.col("number") / tile).cast("int")
    dealt = means.join(center, "number").select(
        F.coalesce("country_code", F.lit("")).alias("country_code"), "number", (F.col("value") - F.col("center")).alias("value"),
        own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")).select(
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "country_code", "number", "value")
    part = F.pmod(F.xxhash64("country_code"), F.lit(TILE_PARTS))
    sums = dealt.repartition("low", "high", part).sortWithinPartitions("low", "high", "country_code").mapInPandas(
        _tile_sums(tile), "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # what rounding leaves of sums without variance counts as none
    varies = (n >= 2) & (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)
    r = F.when(varies, F.round((F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy), 4))
    pairs = spark.range(len(ids) - 1).select(F.col("id").cast("int").alias("a"), F.explode(
        F.sequence(F.col("id").cast("int") + 1, F.lit(len(ids) - 1))).alias("b"))
    found = pairs.join(total.select("a", "b", "n", r.alias("correlation")), ["a", "b"], "left")
    for side in ("a", "b"):
        found = found.join(numbers.select(F.col("number").alias(side), F.col("indicator_id").alias(f"indicator_{side}")), side)
    return found.select("indicator_a", "indicator_b", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), "correlation")


def indicator_summary(panel: DataFrame) -> DataFrame:
    """A4: per indicator row count, distinct countries, year and value range."""
    return (panel.groupBy("indicator_id")
                 .agg(F.count(F.lit(1)).cast("bigint").alias("row_count"),
                      F.countDistinct("country_code").cast("bigint").alias("country_count"),
                      F.min("year").cast("bigint").alias("year_min"),
                      F.max("year").cast("bigint").alias("year_max"),
                      F.min("value").alias("value_min"),
                      F.max("value").alias("value_max")))


def provenance(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """A5: sorted distinct sources, latest year, and a note when the first
    source differs from the registry's primary source."""
    agg = (panel.groupBy("indicator_id")
                .agg(F.array_sort(F.collect_set("source")).alias("_sources"),
                     F.max("year").cast("bigint").alias("latest_year")))
    reg = registry.select(F.col("id").alias("indicator_id"), F.col("source").alias("registry_source"))
    first = F.element_at("_sources", 1)
    return (agg.join(reg, "indicator_id", "left")
               .select("indicator_id",
                       F.array_join("_sources", ",").alias("data_source"),
                       "latest_year",
                       F.when(first != F.col("registry_source"),
                              F.format_string("Primary %s data was unavailable; this result uses %s data.",
                                              F.col("registry_source"), first)).alias("source_note")))


def scope_counts(panel: DataFrame, countries=None, indicator_ids=None) -> DataFrame:
    """Rows per indicator after the country filter, plus the number of
    selected countries.  ``indicator_ids`` (a list or a DataFrame with
    ``indicator_id``) names the indicators asked for: those without rows
    count 0."""
    codes = clean_codes(countries)
    counts = filter_panel(panel, codes).groupBy("indicator_id").agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
    if indicator_ids is not None:
        asked = indicator_ids if isinstance(indicator_ids, DataFrame) else panel.sparkSession.createDataFrame(
            [(i,) for i in indicator_ids], "indicator_id string")
        counts = asked.select("indicator_id").distinct().join(counts, "indicator_id", "left").fillna(0, ["row_count"])
    return counts.withColumn("selected_country_count", F.lit(len(codes)).cast("bigint"))


# -------------------------------------------------------------------- lookups

def registry_lookup(requests: DataFrame, registry: DataFrame, id_col: str = "indicator_id") -> DataFrame:
    """Requested ids joined to the registry; unknown ids carry
    an error message instead of a label."""
    reg = registry.select(F.col("id").alias(id_col), "label", "unit", "source")
    return (requests.join(reg, id_col, "left")
                    .withColumn("error", F.when(F.col("label").isNull(),
                                                F.format_string("Unknown indicator id '%s'", F.col(id_col)))))


def region_rollup(panel: DataFrame, bridge: DataFrame) -> DataFrame:
    """Many-to-many bridge join, aggregated per region; a country in two
    groups counts in both, never summed across groups."""
    return (panel.join(bridge, "country_code")
                 .groupBy("region", "indicator_id", "year")
                 .agg(F.count(F.lit(1)).cast("bigint").alias("n_countries"),
                      F.avg("value").alias("avg_value"),
                      F.min("value").alias("min_value"),
                      F.max("value").alias("max_value")))
