"""The composed chat context of a request (X4 with A4 and A8): one JSON value
per request, decided before anything is collected.

A request names a mode, one or two indicators, at most 50 countries (none:
all), and optionally a year and a rank range.  Row counts come from
counts of the panel by (indicator, country); they decide which requests select
too many rows.  Only then are the rows that the others select taken out of the
panel; aggregates of these give the character counts that decide between raw
records, summaries and the second rejection.  So a request collects at most
``max_rows`` rows an indicator and ``max_chars`` characters, and one rejected
for its rows none.  What several steps read is checkpointed: the counts and
these rows (at most the panel, once for requests with and once for those
without countries), a row per rejected request, per request and indicator, and
per request.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import safe_pearson
from tabulon.operators.dialog import MAX_CONTEXT_CHARS, MAX_ROWS_PER_INDICATOR, record_json
from tabulon.session import cut_lineage, default_parallelism

# Fixed values that must equal the reference's for identical results.
TOP_RECORDS = 25
DEFAULT_RANKS = 10
CONTEXT_NOTE = ("Full raw records exceeded the prompt budget. Use selected_ranking or "
                "selected_correlation as authoritative and use the compact API summaries.")
# end of fixed values

RAW, SUMMARY, TOO_MANY_ROWS, TOO_LONG = "raw", "summary", "reject_rows", "reject_size"
NO_LIST = "[]"


def _number(c: Column) -> Column:
    """A number with four decimals (its length is the same in every engine), or null."""
    return F.format_string("%.4f", c)


def _text(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")


def _or_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _ordered(by: list[str], text: Column) -> Column:
    """Texts of a group as a JSON list, ordered by the columns ``by``."""
    return _json_list(F.transform(F.array_sort(F.collect_list(F.struct(*by, text.alias("_t")))), lambda x: x["_t"]))


class Scope(NamedTuple):
    """Rows (or cells) of the panel that requests select by a list of countries, and those selected without one."""
    listed: DataFrame
    whole: DataFrame


def panel_scope(requests: DataFrame, panel: DataFrame) -> Scope:
    """Rows of ``panel`` that some (request, indicator) row selects.  The panel is not dealt by indicator:
    there are few, and without a list only those of few rows are left."""
    named = requests.where(F.size("countries") > 0).select("indicator_id", F.explode("countries").alias("country_code")).distinct()
    every = requests.where(F.size("countries") == 0).select("indicator_id").distinct()
    return Scope(panel.join(named, ["indicator_id", "country_code"], "left_semi"),
                 panel.join(F.broadcast(every), "indicator_id", "left_semi"))


def selected_rows(requests: DataFrame, scope: Scope, on: list[str] | None = None) -> DataFrame:
    """Rows of ``scope`` that each (request, indicator) row selects: of its countries, or all without any;
    ``on`` are further columns that must be equal."""
    on = ["indicator_id", *(on or [])]
    every = requests.where(F.size("countries") == 0).drop("countries").join(scope.whole, on)
    some = requests.where(F.size("countries") > 0) \
        .withColumn("country_code", F.explode("countries")).drop("countries").join(scope.listed, [*on, "country_code"])
    return some.unionByName(every)


def _cells(panel: DataFrame) -> DataFrame:
    """What the contexts need of every (indicator, country)."""
    return panel.groupBy("indicator_id", "country_code").agg(
        F.count("*").alias("n_rows"), F.sum(F.char_length(record_json())).alias("chars"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.min("country_name").alias("country_name"), F.avg("value").alias("value"))


def _totals(asked: DataFrame, cells: Scope, sums: list[Column], keys: list[str]) -> DataFrame:
    """``sums`` of the cells that each (request, indicator) row selects; without a list, of all cells of the indicator."""
    some = asked.where(F.size("countries") > 0).withColumn("country_code", F.explode("countries")) \
        .join(cells.listed, ["indicator_id", "country_code"]).groupBy(*keys, "at").agg(*sums)
    every = asked.where(F.size("countries") == 0).join(F.broadcast(cells.whole.groupBy("indicator_id").agg(*sums)), "indicator_id")
    return some.unionByName(every.select(*some.columns))


def _head(registry: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The list of a request's indicators as JSON, and each indicator's own object."""
    about = registry.select(F.col("id").alias("indicator_id"), F.to_json(F.struct("id", "label", "unit", "source")).alias("about"))
    named = asked.select(*keys, "at", "indicator_id").join(about, "indicator_id", "left").withColumn(
        "about", F.coalesce("about", F.to_json(F.struct(F.col("indicator_id").alias("id")))))
    return named


def _rankings(asked: DataFrame, scope: Scope, keys: list[str]) -> DataFrame:
    """ranking: the ranks rank_start to rank_end of the selected year as JSON, for requests of that mode."""
    first = asked.where((F.col("mode") == "rankings") & (F.col("at") == 0) & F.col("year").isNotNull()) \
        .select(*keys, "indicator_id", "countries", "year", "rank_start", "rank_end", "order_dir")
    rows = selected_rows(first, scope, ["year"])
    up, down = F.when(F.col("order_dir") == "asc", F.col("value")), F.when(F.col("order_dir") != "asc", F.col("value"))
    order = [F.col("value").isNull(), up.asc(), down.desc(), "country_code"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col("rank").between(F.col("rank_start"), F.col("rank_end")))
    text = F.concat(F.lit('{"rank":'), F.col("rank").cast("string"), F.lit(","), F.substring(record_json(), 2, 1 << 30))
    return kept.groupBy(*keys).agg(_ordered(["rank"], text).alias("ranking"))


def _correlations(asked: DataFrame, cells: Scope, scope: Scope, keys: list[str]) -> DataFrame:
    """correlation: Pearson r over the selected countries with its points as JSON, for requests of that mode."""
    pairs = asked.where(F.col("mode") == "correlation").select(*keys, "at", "indicator_id", "countries", "year")
    columns = [*keys, "at", "country_code", "country_name", "value"]
    rows = selected_rows(pairs.where(F.col("year").isNull()).drop("year"), cells).select(*columns).unionByName(
        selected_rows(pairs.where(F.col("year").isNotNull()), scope, ["year"]).select(*columns))

    def of(at: int, column: str) -> Column:
        return F.when(F.col("at") == at, F.col(column))

    points = rows.groupBy(*keys, "country_code").agg(
        F.min(of(0, "country_name")).alias("country_name"), F.avg(of(0, "value")).alias("x"), F.avg(of(1, "value")).alias("y")) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    names = F.regexp_replace(F.to_json(F.struct("country_code", "country_name")), r"\}$", "")
    point = F.concat(names, F.lit(',"x":'), _number(F.col("x")), F.lit(',"y":'), _number(F.col("y")), F.lit("}"))
    found = points.groupBy(*keys).agg(F.count("*").alias("n"), safe_pearson("x", "y").alias("r"),
                                      _ordered(["country_code"], point).alias("points"))
    text = F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(',"correlation":'),
                    F.when(F.col("n") >= 2, _number(F.col("r"))).otherwise(F.lit("null")), F.lit(',"points":'),
                    F.when(F.col("n") >= 2, F.col("points")).otherwise(F.lit(NO_LIST)), F.lit("}"))
    return found.select(*keys, text.alias("correlation"))


def _top_records(asked: DataFrame, scope: Scope, keys: list[str]) -> DataFrame:
    """top: the best records of the selected year as JSON (A4), for every indicator of the requests."""
    rows = selected_rows(asked.where(F.col("year").isNotNull()).select(*keys, "at", "indicator_id", "countries", "year"), scope, ["year"])
    order = Window.partitionBy(*keys, "at").orderBy(F.col("value").desc_nulls_last(), "country_code")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_RECORDS)
    return best.groupBy(*keys, "at").agg(_ordered(["rank"], record_json()).alias("top"))


def chat_context(requests: DataFrame, panel: DataFrame, registry: DataFrame, request_keys=("request_id",),
                 max_rows: int = MAX_ROWS_PER_INDICATOR, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """``request_keys``, decision, n_chars, context for every request.

    ``requests`` has mode, indicators array<string>, countries array<string>
    (empty or null: all), year, rank_start, rank_end (nullable ints) and
    order_dir; ``panel`` the panel columns; ``registry`` id, label, unit,
    source.  ``decision`` is raw, summary, reject_rows (an indicator selects
    more than ``max_rows`` rows) or reject_size (even the summaries exceed
    ``max_chars``); ``n_chars`` the length of the context (of the summary
    context for reject_size, null for reject_rows), and ``context`` null when
    rejected.  An indicator or country without rows gives empty lists."""
    keys = list(request_keys)
    start = F.coalesce(F.col("rank_start"), F.lit(1))
    clean = requests.select(
        *keys, "mode", "indicators", "year", start.alias("rank_start"),
        F.coalesce(F.col("rank_end"), start + (DEFAULT_RANKS - 1)).alias("rank_end"),
        F.coalesce("order_dir", F.lit("desc")).alias("order_dir"), F.to_json(F.struct(
            F.coalesce("countries", F.array().cast("array<string>")).alias("countries"), "year", "rank_start", "rank_end",
            F.col("order_dir").alias("order"))).alias("filters"),
        F.array_distinct(F.transform(F.coalesce("countries", F.array().cast("array<string>")), F.upper)).alias("countries"))
    panel = panel.select("indicator_id", "country_code", "country_name", "year", "value")
    asked = clean.select("*", F.posexplode("indicators").alias("at", "indicator_id")).drop("indicators")

    # Row counts of every (request, indicator), from those of its countries or of all.
    scopes = asked.select(*keys, "at", "indicator_id", "countries")
    sizes = cut_lineage(panel.groupBy("indicator_id", "country_code").agg(F.count("*").alias("n_rows")))
    rows_of = _totals(scopes, Scope(sizes, sizes), [F.sum("n_rows").alias("n_rows")], keys)
    refused = cut_lineage(rows_of.groupBy(*keys).agg(F.max("n_rows").alias("widest")).where(F.col("widest") > max_rows).select(*keys))
    # Requests are small next to the rows they select: dealt to every core, not merged by their own size.
    going = asked.join(refused, keys, "left_anti").repartition(default_parallelism(panel.sparkSession), *keys)
    scope = Scope(*map(cut_lineage, panel_scope(going, panel)))
    cells = Scope(*map(_cells, scope))

    # The fixed parts of the requests that go on.
    sums = [F.sum("n_rows").alias("n_rows"), F.sum("chars").alias("chars"), F.count("*").alias("country_count"),
            F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
            F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max")]
    counts = _totals(going.select(*scopes.columns), cells, sums, keys)
    parts = cut_lineage(_head(registry, going, keys).join(counts, [*keys, "at"], "left").fillna(0, ["n_rows", "chars", "country_count"]))
    raw_part = F.concat(F.lit('{"indicator":'), F.col("about"), F.lit(',"indicator_id":'), _text(F.col("indicator_id")),
                        F.lit(',"records":'))
    parts = parts.withColumn("raw_head", raw_part).withColumn(
        "raw_chars", F.char_length("raw_head") + F.col("chars") + F.greatest(F.col("n_rows") - 1, F.lit(0)) + 3)
    heads = parts.groupBy(*keys).agg(_ordered(["at"], F.col("about")).alias("about"),
                                     (F.sum("raw_chars") + F.count("*") - 1).alias("raw_chars"))
    fixed = clean.join(refused, keys, "left_anti").join(heads, keys, "left") \
        .join(_rankings(going, scope, keys), keys, "left").join(_correlations(going, cells, scope, keys), keys, "left")
    head = F.concat(F.lit('{"mode":'), _text(F.col("mode")), F.lit(',"filters":'), F.col("filters"), F.lit(',"indicators":'),
                    F.coalesce("about", F.lit(NO_LIST)), F.lit(',"selected_ranking":'), F.coalesce("ranking", F.lit(NO_LIST)),
                    F.lit(',"selected_correlation":'), F.coalesce("correlation", F.lit("null")), F.lit(',"api_data":['))
    fixed = cut_lineage(fixed.select(*keys, head.alias("head"), F.coalesce("raw_chars", F.lit(0)).alias("raw_chars")))
    fits = F.char_length("head") + F.col("raw_chars") + 2 <= max_chars
    raw, other = fixed.where(fits), fixed.where(~fits)

    # Raw: the records of requests that fit.
    rows = selected_rows(going.join(raw.select(*keys), keys, "left_semi").select(*keys, "at", "indicator_id", "countries"), scope)
    records = rows.groupBy(*keys, "at").agg(_ordered(["country_code", "year", "value"], record_json()).alias("records"))
    raw_data = parts.join(raw.select(*keys), keys, "left_semi").join(records, [*keys, "at"], "left").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(
            F.col("raw_head"), F.coalesce("records", F.lit(NO_LIST)), F.lit("}")).alias("t")))), lambda x: x["t"]), ",").alias("data"))
    as_raw = raw.join(raw_data, keys, "left").select(
        *keys, F.lit(RAW).alias("decision"), F.concat("head", F.coalesce("data", F.lit("")), F.lit("]}")).alias("context"))

    # Summaries of the others.
    left = going.join(other.select(*keys), keys, "left_semi")
    years = left.select(*keys, "at", "year")
    summed = parts.join(other.select(*keys), keys, "left_semi").join(years, [*keys, "at"]).join(_top_records(left, scope, keys), [*keys, "at"], "left")
    has = F.col("n_rows") > 0
    summary = F.concat(
        F.lit('{"indicator":'), F.col("about"), F.lit(',"indicator_id":'), _text(F.col("indicator_id")),
        F.lit(',"row_count":'), F.col("n_rows").cast("string"), F.lit(',"country_count":'), F.col("country_count").cast("string"),
        F.lit(',"year_min":'), _or_null(F.col("year_min")), F.lit(',"year_max":'), _or_null(F.col("year_max")),
        F.when(has, F.concat(F.lit(',"value_min":'), _number(F.col("value_min")), F.lit(',"value_max":'), _number(F.col("value_max"))))
        .otherwise(F.lit("")),
        F.when(F.col("year").isNotNull(), F.concat(F.lit(',"selected_year":'), F.col("year").cast("string"),
                                                   F.lit(',"selected_year_top_records":'), F.coalesce("top", F.lit(NO_LIST))))
        .otherwise(F.lit("")), F.lit("}"))
    shorter = summed.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", summary.alias("t")))), lambda x: x["t"]), ",").alias("data"))
    note = F.concat(F.lit('],"context_note":'), F.lit(f'"{CONTEXT_NOTE}"'), F.lit("}"))
    as_summary = other.join(shorter, keys, "left").select(
        *keys, F.concat("head", F.coalesce("data", F.lit("")), note).alias("context")).select(
        *keys, F.when(F.char_length("context") <= max_chars, F.lit(SUMMARY)).otherwise(F.lit(TOO_LONG)).alias("decision"), "context")
    kept = as_raw.unionByName(as_summary).select(
        *keys, "decision", F.char_length("context").cast("bigint").alias("n_chars"),
        F.when(F.col("decision") != TOO_LONG, F.col("context")).alias("context"))
    none = refused.select(*keys, F.lit(TOO_MANY_ROWS).alias("decision"), F.lit(None).cast("bigint").alias("n_chars"),
                          F.lit(None).cast("string").alias("context"))
    return reduce(DataFrame.unionByName, [kept, none])
