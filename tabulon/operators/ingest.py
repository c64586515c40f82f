"""Feed normalisation into the panel (N1-N10) and load bookkeeping.

Two feed shapes arrive:

* dimensioned feeds (``SpatialDimType, SpatialDim, TimeDim, Dim1, Dim3,
  NumericValue`` plus ``indicator_id``): country rows only, data-dependent
  collapse of breakdown dimensions to their total, name lookup with a code
  fallback, lenient numbers, duplicate collapse by mean;
* entity feeds (``Entity, Code, Year|Day, <value>``): ISO-3 filter, the value
  column probed from the schema, daily series reduced to the latest reading
  of each year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import lenient_double

# The breakdown codes that denote "all categories".
TOTAL_DIM1 = "SEX_BTSX"
TOTAL_DIM3 = "WEALTHQUINTILE_TOTL"

# Words that a CSV reader of data frames reads as missing.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
            "NULL", "NaN", "None", "n/a", "nan", "null")

# Parts that the rows of one key are dealt to where they meet a row per key.
SPREAD = 32

PANEL_KEYS = ("country_code", "country_name", "year", "indicator_id", "source")

DIM_FEED_SCHEMA = (
    "indicator_id string, SpatialDimType string, SpatialDim string, TimeDim string, "
    "Dim1 string, Dim3 string, NumericValue string"
)


def keep_country_rows(feed: DataFrame) -> DataFrame:
    """N2."""
    return feed.where(F.col("SpatialDimType") == "COUNTRY")


def collapse_total(feed: DataFrame, dim: str, total: str, key: str = "indicator_id") -> DataFrame:
    """N3 for one breakdown column, per ``key``: when the column has any
    non-null value and some row is the total (or null), keep only null-or-total
    rows; when no total exists keep every row (they are averaged later)."""
    return collapse_totals(feed, [(dim, total)], key)


def collapse_totals(feed: DataFrame, dims: list[tuple[str, str]], key: str = "indicator_id") -> DataFrame:
    """N3 applied to several breakdown columns in sequence (Dim1, then Dim3
    on what Dim1 left), in ONE aggregate over the feed.

    Column j's flags depend on which rows survived columns 1..j-1, which in
    turn depends on those columns' collapse decisions.  The aggregate
    therefore computes column j's flags under every combination of earlier
    decisions (2^(j-1) masked max() pairs, 3 for the usual two columns), and
    the decisions are resolved per key on the small flag table, so the feed
    is read twice in total (flags, then the filter), never once per column,
    and no window over a hot key is needed.  A feed has few keys, so each
    key's rows meet its decisions in ``SPREAD`` parts."""
    dims = [(d, t) for d, t in dims if d in feed.columns]
    if not dims:
        return feed

    def row_ok(d, t):
        return F.col(d).isNull() | (F.col(d) == t)

    aggs = []
    for j, (d, t) in enumerate(dims):
        for combo in range(1 << j):
            surv = F.lit(True)
            for i in range(j):
                if combo >> i & 1:      # earlier column i collapsed: only its ok rows survive
                    surv = surv & row_ok(*dims[i])
            aggs.append(F.max(F.when(surv, F.col(d).isNotNull().cast("int")).otherwise(0)).alias(f"_a{j}_{combo}"))
            aggs.append(F.max(F.when(surv, row_ok(d, t).cast("int")).otherwise(0)).alias(f"_t{j}_{combo}"))
    flags = feed.groupBy(key).agg(*aggs)
    for j in range(len(dims)):
        # combo index from the earlier decisions, as an expression
        idx = F.lit(0)
        for i in range(j):
            idx = idx + F.when(F.col(f"_c{i}"), F.lit(1 << i)).otherwise(F.lit(0))
        any_v = F.element_at(F.array(*[F.col(f"_a{j}_{c}") for c in range(1 << j)]), idx + 1)
        has_t = F.element_at(F.array(*[F.col(f"_t{j}_{c}") for c in range(1 << j)]), idx + 1)
        flags = flags.withColumn(f"_c{j}", (any_v == 1) & (has_t == 1))
    # One row per key and part, joined back null-safe (rows without a key are a
    # key of their own).  By the key alone, AQE keeps the shuffle join (most
    # partitions are empty) and one task reads a whole indicator.
    flags = flags.select(F.col(key).alias("_flag_key"), *[f"_c{j}" for j in range(len(dims))],
                         F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_flag_part"))
    parted = feed.withColumn("_part", (F.monotonically_increasing_id() % SPREAD).cast("int"))
    keep = F.lit(True)
    for j, (d, t) in enumerate(dims):
        keep = keep & (~F.coalesce(F.col(f"_c{j}"), F.lit(False)) | row_ok(d, t))
    same = F.col(key).eqNullSafe(F.col("_flag_key")) & (F.col("_part") == F.col("_flag_part"))
    return (parted.join(flags, same, "left").where(keep)
                  .drop("_part", "_flag_part", "_flag_key", *[f"_c{j}" for j in range(len(dims))]))


def normalise_dim_feed(feed: DataFrame, names: DataFrame | None, source: str = "WHO",
                       mean_scale: int | None = None) -> DataFrame:
    """N1-N8 for a dimensioned feed holding any number of indicators.

    ``names`` is a (Code, Title) dimension; codes without a title keep the
    code as their name (N4, J3: a broadcast-sized left join).  Rows missing a
    year, value or code are dropped and the year truncated to int (N6).  Dim1 is collapsed first, then Dim3 on what
    remains (sequential, as the flags depend on the earlier filter).
    ``mean_scale`` selects the exact-decimal mean (see ``functions.mean``).

    Every later step depends only on a row's keys and breakdowns, so the rows
    are summed by these before they are shuffled; the sums are collapsed,
    named and averaged."""
    dims = [(d, t) for d, t in (("Dim1", TOTAL_DIM1), ("Dim3", TOTAL_DIM3)) if d in feed.columns]
    value = lenient_double(F.col("NumericValue").cast("string"))
    rows = keep_country_rows(feed).select(
        "indicator_id", "SpatialDim", "TimeDim", *[d for d, _ in dims], value.alias("value"))
    rows = collapse_totals(_sums(rows, mean_scale), dims).where(F.col("_n") > 0)
    if names is not None:
        rows = rows.join(names.select(F.col("Code").alias("SpatialDim"), F.col("Title")),
                         "SpatialDim", "left")
        name = F.coalesce(F.col("Title"), F.col("SpatialDim"))
    else:
        name = F.col("SpatialDim")
    year = lenient_double(F.col("TimeDim").cast("string"))
    projected = rows.select(
        F.col("SpatialDim").alias("country_code"), name.alias("country_name"),
        year.alias("_year"), F.col("indicator_id"), "_total", "_exact", "_n", F.lit(source).alias("source"),
    )
    complete = (projected.where(F.col("_year").isNotNull() & F.col("country_code").isNotNull())
                .withColumn("year", F.col("_year").cast("int")).drop("_year"))
    # Sums that were dropped above may overflow, those of the panel may not.
    total = F.when(F.col("_total").isNotNull() & (F.col("_exact") == F.col("_n")), F.col("_total")) \
        .otherwise(F.raise_error(F.lit("a value or a sum of values is too large for the exact mean")))
    return (complete.groupBy(*PANEL_KEYS)
                    .agg((F.sum(total).cast("double") / F.sum("_n").cast("double")).alias("value"))
                    .select("country_code", "country_name", "year", "indicator_id", "value", "source"))


def _sums(rows: DataFrame, scale: int | None) -> DataFrame:
    """``_total`` of ``value`` and the number ``_n`` of values by all other
    columns (``_exact``: of those that fit DECIMAL(38, scale)); too large a
    total is null."""
    number = F.col("value") if scale is None else F.col("value").try_cast(f"decimal(38,{scale})")
    return rows.groupBy(*[c for c in rows.columns if c != "value"]).agg(
        F.try_sum(number).alias("_total"), F.count(number).alias("_exact"), F.count("value").alias("_n"))


def probe_entity_columns(columns) -> tuple[str, str]:
    """Time column is ``Year`` else ``Day``; the value column is the first
    column not in {Entity, Code, Year, Day}.  Metadata only, no job runs."""
    cols = list(columns)
    if "Year" in cols:
        time_col = "Year"
    elif "Day" in cols:
        time_col = "Day"
    else:
        raise ValueError(f"no recognized time column (columns found: {cols})")
    value_cols = [c for c in cols if c not in ("Entity", "Code", "Year", "Day", "_seq", "indicator_id")]
    if not value_cols:
        raise ValueError("no value column")
    return time_col, value_cols[0]


def normalise_entity_feed(feed: DataFrame, indicator_id: str | None = None,
                          source: str = "OWID", seq_col: str = "_seq") -> DataFrame:
    """N1, N5-N7, N9, N10 for an entity feed.

    ``indicator_id`` may be a constant or already a column of ``feed``.  Rows
    missing a year or value are dropped, the year truncated (N6).  Daily
    feeds keep, per (country, year), the value of the latest day, ties going
    to the later input row (``seq_col``; W9 latest row per key as one
    ``max_by`` aggregate); yearly duplicates are kept."""
    time_col, value_col = probe_entity_columns(feed.columns)
    code = F.col("Code").cast("string")
    rows = feed.where(code.isNotNull() & (F.char_length(code) == 3) & ~code.isin(*NA_WORDS))
    ind = F.col("indicator_id") if indicator_id is None else F.lit(indicator_id)
    if time_col == "Year":
        year = lenient_double(F.col("Year").cast("string"))
        day = F.lit(None).cast("timestamp")
    else:
        day = F.try_to_timestamp(F.col("Day").cast("string"))
        year = F.year(day).cast("double")
    base = rows.select(
        code.alias("country_code"), F.col("Entity").cast("string").alias("country_name"),
        year.alias("_year"), ind.alias("indicator_id"),
        lenient_double(F.col(value_col).cast("string")).alias("value"), F.lit(source).alias("source"),
        day.alias("_day"),
        (F.col(seq_col) if seq_col in feed.columns else F.lit(0)).cast("bigint").alias("_seq"),
    )
    complete = (base.where(F.col("_year").isNotNull() & F.col("value").isNotNull())
                    .withColumn("year", F.col("_year").cast("int")).drop("_year"))
    # A missing name (or one of the words read as missing) is no group of its own.
    named = F.col("country_name").isNotNull() & ~F.col("country_name").isin(*NA_WORDS)
    if time_col == "Year":
        return complete.select("country_code", "country_name", "year", "indicator_id", "value", "source")
    return (complete.where(named).groupBy(*PANEL_KEYS)
                    .agg(F.max_by("value", F.struct("_day", "_seq")).alias("value"))
                    .select("country_code", "country_name", "year", "indicator_id", "value", "source"))


def fresh_snapshots(log: DataFrame, as_of, key: str = "key", ts: str = "fetched_at",
                    ttl_seconds: int = 3600) -> DataFrame:
    """Per key, the latest snapshot and whether it is still fresh
    (``as_of - fetched_at < ttl``, strict); stale keys are the reload list.

    ``as_of`` is a literal timestamp or a one-row DataFrame with an ``as_of``
    column (evaluated once as a scalar subquery, no join)."""
    latest = log.groupBy(key).agg(F.max(ts).alias("latest_fetched_at"),
                                  F.count(F.lit(1)).cast("bigint").alias("n_snapshots"))
    if isinstance(as_of, DataFrame):
        latest = latest.withColumn("as_of", as_of.select("as_of").scalar())
    else:
        latest = latest.withColumn("as_of", F.lit(as_of).cast("timestamp"))
    age = (F.unix_micros(F.col("as_of").cast("timestamp")) -
           F.unix_micros(F.col("latest_fetched_at").cast("timestamp"))).cast("double") / F.lit(1_000_000.0)
    return (latest.withColumn("age_seconds", age)
                  .withColumn("fresh", F.col("age_seconds") < ttl_seconds))


def choose_source(registry: DataFrame, load_status: DataFrame) -> DataFrame:
    """Whole-series fallback.  Primary is used when its load succeeded
    (even if empty); else the fallback if it succeeded; else the primary's
    error.  ``load_status`` is (indicator_id, source, ok)."""
    ok = load_status.where(F.col("ok")).select("indicator_id", "source").distinct()
    prim = ok.select("indicator_id", F.col("source").alias("source_primary"), F.lit(True).alias("primary_ok"))
    fall = ok.select("indicator_id", F.col("source").alias("fallback_source"), F.lit(True).alias("fallback_ok"))
    reg = registry.select(F.col("id").alias("indicator_id"), F.col("source").alias("source_primary"),
                          "fallback_source")
    chosen = (reg.join(prim, ["indicator_id", "source_primary"], "left")
                 .join(fall, ["indicator_id", "fallback_source"], "left"))
    used = (F.when(F.col("primary_ok"), F.col("source_primary"))
             .when(F.col("fallback_ok"), F.col("fallback_source")))
    return chosen.select(
        "indicator_id", used.alias("source_used"),
        F.when(used.isNull(), F.format_string("Primary %s load failed", F.col("source_primary"))).alias("error"),
    )


def apply_source_choice(raw_panel: DataFrame, choice: DataFrame) -> DataFrame:
    """Keep, per indicator, only the rows of the chosen source.  ``choice``
    has one row per registry entry; Spark broadcasts it while it is small."""
    c = choice.where(F.col("source_used").isNotNull()).select(
        "indicator_id", F.col("source_used").alias("source"))
    return raw_panel.join(c, ["indicator_id", "source"], "left_semi")
