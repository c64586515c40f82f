"""Dialog operators: turn filtering and history windows (F7, W5, W6), message
and request rule sets (N20, N21), deterministic command extraction with alias
and region containment joins (X1, J9, J10), action validation (N22), and the
budgeted context rollup (A8, X4).

The reference evaluates these once per HTTP request on Python dicts; here each
one is a whole-table job: one row per message / request / record, with every
rule an expression so the plan stays inside whole-stage codegen.  The small
fixed dimensions (indicator registry, region groups) enter as literal arrays
whose size is checked, never as a join that could multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import py_strip

# Fixed values that must equal the reference's for identical results.
HISTORY_ITEMS = 12          # last N history items kept (before cleaning)
MESSAGE_CHARS = 800         # cut / limit for chat messages
REQUEST_MESSAGE_CHARS = 1000
REQUEST_MAX_HISTORY = 8
REQUEST_MAX_INDICATORS = 2
REQUEST_MAX_COUNTRIES = 50
REQUEST_MAX_ROWS = 120
REQUEST_MAX_POINTS = 120
REQUEST_MAX_STATISTICS = 8
REQUEST_MAX_INT = 10000
RECORD_NAME_CHARS = 120
RECORD_KEYS = ("country_code", "country_name", "year", "value", "change", "pct_change", "rank", "x", "y")
RECORD_NAME_KEYS = ("country_code", "country_name")
MODES = ("trend", "rankings", "correlation")
ROLES = ("user", "assistant")
COUNTRY_CODE_PATTERN = r"\A[A-Z0-9_-]{1,12}\z"
MAX_RANK = 1000
MAX_ROWS_PER_INDICATOR = 12_000
MAX_CONTEXT_CHARS = 400_000
RANK_RE = r"(?U)\branks?\s+(\d+)\s*(?:to|through|-)\s*(\d+)\b"
YEAR_RANGE_RE = r"(?U)\b(?:between|from)\s+(19\d{2}|20\d{2})\s+(?:and|to)\s+(19\d{2}|20\d{2})\b"
YEAR_RE = r"(?U)\bin\s+(19\d{2}|20\d{2})\b"
# end of fixed values


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------ F7, W5, W6

def turn_filter(turns: DataFrame, role: str = "role", text: str = "text", trim: bool = True) -> DataFrame:
    """keep user/assistant turns with non-blank text (``trim=False``
    keeps the untrimmed test of the second app: any non-empty string)."""
    body = py_strip(F.col(text)) if trim else F.col(text)
    return turns.where(F.col(role).isin(*ROLES) & F.col(text).isNotNull() & (body != F.lit("")))


def clean_history(turns: DataFrame, keys=("conv_id",), order: str = "turn", n: int = HISTORY_ITEMS,
                  max_chars: int = MESSAGE_CHARS, role: str = "role", text: str = "text") -> DataFrame:
    """The last ``n`` items by position *first*, then drop bad roles and
    blank text, then trim and cut to ``max_chars`` (so fewer than ``n`` may
    remain).  The cut ``rn <= n`` over a descending row_number lets Spark
    insert a per-group limit before the window's sort."""
    if n < 1:
        raise ValueError("n must be positive")
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    kept = turn_filter(last, role, text, trim=True)
    return kept.withColumn("content", F.substring(py_strip(F.col(text)), 1, max_chars)).drop(text)


def history_with_current(history: DataFrame, current: DataFrame, keys=("conv_id",), order: str = "turn",
                         role: str = "role") -> DataFrame:
    """Append the current message (``keys``, ``order``, ``message``) as a
    user item unless it equals the content of the last kept history item.
    Returns the final message list: ``keys``, ``position`` (1-based), role,
    content."""
    keys = list(keys)
    last = history.groupBy(*keys).agg(F.max_by("content", F.col(order)).alias("_last"),
                                      F.count(F.lit(1)).alias("_n"))
    cur = (current.join(last, keys, "left")
                  .where(F.col("_last").isNull() | (F.col("_last") != F.col("message")))
                  .select(*keys, F.lit(True).alias("_current"), F.lit(None).cast("bigint").alias(order),
                          F.lit("user").alias(role), F.col("message").alias("content")))
    allm = history.select(*keys, F.lit(False).alias("_current"), F.col(order).cast("bigint").alias(order), role,
                          "content").unionByName(cur)
    w = Window.partitionBy(*keys).orderBy("_current", order)
    return allm.withColumn("position", F.row_number().over(w).cast("bigint")).drop(order, "_current")


def message_check(messages: DataFrame, text: str = "text", max_chars: int = MESSAGE_CHARS) -> DataFrame:
    """N21 (second rule set): trimmed message must be non-empty and at most
    ``max_chars`` characters.  Adds ``status`` in ok / empty / too_long and
    the trimmed ``message``."""
    body = py_strip(F.col(text))
    status = (F.when(F.col(text).isNull() | (body == F.lit("")), F.lit("empty"))
               .when(F.char_length(body) > max_chars, F.lit("too_long"))
               .otherwise(F.lit("ok")))
    return messages.withColumn("message", body).withColumn("status", status)


# ------------------------------------------------------------------ N20

def record_check(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Whitelist check of JSON records.  Keys outside the whitelist are
    ignored; names must be strings of at most 120 characters; every other
    known key must be a finite number (not a boolean, not null); a single
    violation rejects the record, and a record with no known key is rejected.

    The JSON is parsed once into a VARIANT so the raw token type (string,
    number, boolean, null) is visible; unparseable text is rejected.
    Adds ``valid``, ``n_known`` and the first failing key as ``bad_key``."""
    v = F.expr(f"try_parse_json(`{json_col}`)")
    checks = []
    for k in RECORD_KEYS:
        field = F.expr(f"variant_get(_v, '$.{k}')")
        typ = F.expr(f"schema_of_variant(variant_get(_v, '$.{k}'))")
        present = field.isNotNull()
        if k in RECORD_NAME_KEYS:
            ok = (typ == F.lit("STRING")) & (F.char_length(F.expr(f"variant_get(_v, '$.{k}', 'string')"))
                                             <= RECORD_NAME_CHARS)
        else:
            num = F.expr(f"try_variant_get(_v, '$.{k}', 'double')")
            ok = ((typ.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | typ.startswith("DECIMAL"))
                  & ~F.isnan(num) & (F.abs(num) < F.lit(float("inf"))))
        checks.append((k, present, ok))
    n_known = sum((F.when(p, 1).otherwise(0) for _, p, _ in checks), F.lit(0))
    bad = F.coalesce(*[F.when(p & ~ok, F.lit(k)) for k, p, ok in checks])
    is_obj = F.expr("schema_of_variant(_v)").startswith("OBJECT")
    return (records.withColumn("_v", v)
                   .withColumn("n_known", F.when(is_obj, n_known).otherwise(F.lit(0)).cast("int"))
                   .withColumn("bad_key", F.when(is_obj, bad))
                   .withColumn("valid", F.coalesce(is_obj, F.lit(False)) & (F.col("n_known") > 0)
                               & F.col("bad_key").isNull())
                   .drop("_v"))


# ------------------------------------------------------------------ N21

def _abs_ok(col: Column) -> Column:
    return col.isNull() | (F.abs(col) <= REQUEST_MAX_INT)


def _history_ok(role: Column, content: Column) -> Column:
    body = py_strip(content)
    return (role.isin(*ROLES) & content.isNotNull() & (body != F.lit(""))
            & (F.char_length(body) <= REQUEST_MESSAGE_CHARS))


def request_check(requests: DataFrame, registry_ids: list[str], keys=("conv_id",),
                  history_turns: DataFrame | None = None) -> DataFrame:
    """The chat request rule set over a table of requests with columns
    message, mode, indicators array<string>, countries array<string>, year,
    top_n, rank_start, rank_end (ints, nullable), order_dir, n_rows,
    n_points, n_statistics.

    The history is either an array<struct<role, content>> column ``history``
    on the request, or a long table ``history_turns`` (keys, role, content)
    whose rules are aggregated per request (count + all-ok), so a long
    history is never collected into one row.

    Adds ``reason`` (the first failing rule in the reference's order, NULL
    when valid), ``valid`` and the upper-cased ``countries_clean``.
    Registry membership is a check against a literal array of the registry's
    ids (a fixed dimension, size-checked)."""
    keys = list(keys)
    if history_turns is not None:
        h = history_turns.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n_hist"),
            F.bool_and(F.coalesce(_history_ok(F.col("role"), F.col("content")), F.lit(False))).alias("_hist_ok"))
        requests = requests.join(h, keys, "left")
        n_hist = F.coalesce(F.col("_n_hist"), F.lit(0))
        hist_ok = F.coalesce(F.col("_hist_ok"), F.lit(True))
    else:
        hist = F.coalesce(F.col("history"), F.array())
        n_hist = F.size(hist)
        hist_ok = F.forall(hist, lambda x: _history_ok(x["role"], x["content"]))
    reg = F.array(*[F.lit(i) for i in registry_ids])
    msg = py_strip(F.col("message"))
    inds = F.coalesce(F.col("indicators"), F.array().cast("array<string>"))
    ctry = F.coalesce(F.col("countries"), F.array().cast("array<string>"))
    expected = F.when(F.col("mode") == F.lit("correlation"), F.lit(2)).otherwise(F.lit(1))
    rules = [
        ("message", F.col("message").isNotNull() & (msg != F.lit(""))
         & (F.char_length(msg) <= REQUEST_MESSAGE_CHARS)),
        ("mode", F.col("mode").isNotNull() & F.col("mode").isin(*MODES)),
        ("indicators", (F.size(inds) <= REQUEST_MAX_INDICATORS)
         & F.forall(inds, lambda i: i.isNotNull() & F.array_contains(reg, i))),
        ("indicator_count", (F.size(inds) == expected) & (F.size(F.array_distinct(inds)) == F.size(inds))),
        ("countries", (F.size(ctry) <= REQUEST_MAX_COUNTRIES)
         & F.forall(ctry, lambda c: F.coalesce(F.upper(c).rlike(COUNTRY_CODE_PATTERN), F.lit(False)))),
        ("integers", _abs_ok(F.col("year")) & _abs_ok(F.col("top_n"))
         & _abs_ok(F.col("rank_start")) & _abs_ok(F.col("rank_end"))),
        ("order", F.col("order_dir").isNull() | F.col("order_dir").isin("asc", "desc")),
        ("snapshot", (F.coalesce(F.col("n_rows"), F.lit(0)) <= REQUEST_MAX_ROWS)
         & (F.coalesce(F.col("n_points"), F.lit(0)) <= REQUEST_MAX_POINTS)
         & (F.coalesce(F.col("n_statistics"), F.lit(0)) <= REQUEST_MAX_STATISTICS)),
        ("history", (n_hist <= REQUEST_MAX_HISTORY) & hist_ok),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    out = (requests.withColumn("reason", reason)
                   .withColumn("valid", F.col("reason").isNull())
                   .withColumn("countries_clean", F.transform(ctry, lambda c: F.upper(c))))
    return out.drop("_n_hist", "_hist_ok")


# --------------------------------------------------------- X1, J9, J10

def _containment_pick(text: Column, entries: list[tuple[str, tuple[str, ...]]]) -> Column:
    """First entry (in the given order) having any alias contained in
    ``text``; entries are (value, aliases).  Bounded literal array."""
    if not entries:
        return F.lit(None).cast("string")
    width = max(len(a) for _, a in entries)
    arr = F.array(*[F.struct(F.lit(v).alias("v"),
                             F.array(*[F.lit(x) for x in (list(a) + [a[0]] * (width - len(a)))]).alias("a"))
                    for v, a in entries])
    hits = F.filter(arr, lambda e: F.exists(e["a"], lambda x: F.contains(text, x)))
    return F.get(hits, 0)["v"]


def indicator_aliases(registry: list[tuple]) -> list[tuple[str, tuple[str, str]]]:
    """J9 order: entries by label length, longest first; ties keep registry
    order (a stable sort).  Aliases: the id with '_' as spaces, the
    lower-cased label."""
    order = sorted(range(len(registry)), key=lambda i: -len(registry[i][1]))
    return [(registry[i][0], (registry[i][0].replace("_", " "), registry[i][1].lower())) for i in order]


def region_aliases(groups: dict) -> list[tuple[str, tuple[str]]]:
    """J10 order: region names by length, longest first (stable)."""
    return [(name, (name.lower(),)) for name in sorted(groups, key=len, reverse=True)]


def _as_int(digits: Column) -> Column:
    """Digits -> int; overlong numbers saturate above every bound checked
    (Python ints do not overflow)."""
    trimmed = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.char_length(trimmed) > 9, F.lit(1_000_000_000)).otherwise(trimmed.try_cast("int"))


def extract_command(messages: DataFrame, registry: list[tuple], groups: dict, text: str = "message",
                    context_indicator: str = "context_indicator", context_year: str = "context_year") -> DataFrame:
    """Deterministic dashboard action per message, or NULL.

    Precedence: rank range (invalid range -> no action at all) > region
    (mode correlation when the text says correlation/compare, else trend;
    years dropped) > year range (needs trend/over time/between/from).  The
    indicator comes from the longest contained label/alias (J9), else the
    message's context indicator; the region from the longest contained
    region name (J10, plain substring)."""
    low = F.lower(F.col(text))
    ind = F.coalesce(_containment_pick(low, indicator_aliases(registry)), F.col(context_indicator))
    region = _containment_pick(low, region_aliases(groups))
    has_rank = low.rlike(RANK_RE)
    r_start = _as_int(F.regexp_extract(low, RANK_RE, 1))
    r_end = _as_int(F.regexp_extract(low, RANK_RE, 2))
    has_year = low.rlike(YEAR_RE)
    year = F.when(has_year, F.regexp_extract(low, YEAR_RE, 1).cast("int")).otherwise(F.col(context_year))
    has_range = low.rlike(YEAR_RANGE_RE)
    y_min = F.regexp_extract(low, YEAR_RANGE_RE, 1).cast("int")
    y_max = F.regexp_extract(low, YEAR_RANGE_RE, 2).cast("int")
    trend_word = (F.contains(low, F.lit("trend")) | F.contains(low, F.lit("over time"))
                  | F.contains(low, F.lit("between")) | F.contains(low, F.lit("from")))
    corr_word = F.contains(low, F.lit("correlation")) | F.contains(low, F.lit("compare"))
    null_i = F.lit(None).cast("int")
    null_s = F.lit(None).cast("string")

    def action(mode, ind_id, year_, start, end, region_, ymin, ymax):
        return F.struct(mode.alias("mode"), ind_id.alias("indicator_id"), year_.alias("year"),
                        start.alias("rank_start"), end.alias("rank_end"), region_.alias("region"),
                        ymin.alias("year_min"), ymax.alias("year_max"))

    rank_ok = (r_start >= 1) & (r_end >= r_start) & (r_end <= MAX_RANK) & ind.isNotNull()
    act = (F.when(has_rank, F.when(rank_ok, action(F.lit("rankings"), ind, year, r_start, r_end,
                                                   null_s, null_i, null_i)))
            .when(region.isNotNull() & ind.isNotNull(),
                  action(F.when(corr_word, F.lit("correlation")).otherwise(F.lit("trend")), ind, null_i,
                         null_i, null_i, region, null_i, null_i))
            .when(has_range & trend_word & ind.isNotNull(),
                  action(F.lit("trend"), ind, null_i, null_i, null_i, null_s, y_min, y_max)))
    return messages.withColumn("action", act)


# ------------------------------------------------------------------ N22

def action_check(actions: DataFrame, registry_ids: list[str], groups: dict, action: str = "action") -> DataFrame:
    """Validate an action struct (mode, indicator_id, indicator_x_id?,
    indicator_y_id?, year, year_min, year_max, rank_start, rank_end, region,
    country_codes?).  Rankings get default range start 1, end start+9 and must
    satisfy 1 <= start <= end <= 1000; trend needs year_min <= year_max; a
    region must exist and expands to its codes (not held to 50); explicit
    country_codes override it (<= 50, upper-cased, ordered distinct).
    Adds ``valid_action`` (NULL when rejected)."""
    a = F.col(action)
    fields = set(actions.schema[action].dataType.fieldNames())

    def fld(name, typ="string"):
        return a[name] if name in fields else F.lit(None).cast(typ)
    reg = F.array(*[F.lit(i) for i in registry_ids])
    region_map = F.create_map(*[x for name, codes in groups.items()
                                for x in (F.lit(name), F.array(*[F.lit(c) for c in codes.split()]))])
    mode = fld("mode")
    ind_ok = F.array_contains(reg, fld("indicator_id"))
    x_id, y_id = fld("indicator_x_id"), fld("indicator_y_id")
    pair_ok = (x_id != y_id) & F.array_contains(reg, x_id) & F.array_contains(reg, y_id)
    ints_ok = F.lit(True)
    for n in ("year", "year_min", "year_max", "rank_start", "rank_end"):
        ints_ok = ints_ok & _abs_ok(fld(n, "int"))
    start = F.coalesce(fld("rank_start", "int"), F.lit(1))
    end = F.coalesce(fld("rank_end", "int"), start + 9)
    rank_ok = F.when(mode == "rankings", (start >= 1) & (end >= start) & (end <= MAX_RANK)).otherwise(True)
    trend_ok = F.when((mode == "trend") & fld("year_min", "int").isNotNull() & fld("year_max", "int").isNotNull(),
                      fld("year_min", "int") <= fld("year_max", "int")).otherwise(True)
    region = fld("region")
    region_ok = region.isNull() | F.map_contains_key(region_map, region)
    codes = fld("country_codes", "array<string>")
    codes_ok = codes.isNull() | ((F.size(codes) <= REQUEST_MAX_COUNTRIES)
                                 & F.forall(codes, lambda c: F.coalesce(F.upper(c).rlike(COUNTRY_CODE_PATTERN),
                                                                        F.lit(False))))
    ok = (mode.isin(*MODES)
          & F.when(mode == "correlation", pair_ok).otherwise(ind_ok)
          & ints_ok & rank_ok & trend_ok & region_ok & codes_ok)
    final_codes = F.when(codes.isNotNull(), F.array_distinct(F.transform(codes, lambda c: F.upper(c)))) \
                   .otherwise(F.when(region.isNotNull(), F.element_at(region_map, region)))
    valid = F.struct(
        mode.alias("mode"),
        F.when(mode != "correlation", fld("indicator_id")).alias("indicator_id"),
        F.when(mode == "correlation", x_id).alias("indicator_x_id"),
        F.when(mode == "correlation", y_id).alias("indicator_y_id"),
        fld("year", "int").alias("year"),
        fld("year_min", "int").alias("year_min"), fld("year_max", "int").alias("year_max"),
        F.when(mode == "rankings", start).otherwise(fld("rank_start", "int")).alias("rank_start"),
        F.when(mode == "rankings", end).otherwise(fld("rank_end", "int")).alias("rank_end"),
        region.alias("region"), final_codes.alias("country_codes"))
    return actions.withColumn("valid_action", F.when(F.coalesce(ok, F.lit(False)), valid))


# ------------------------------------------------------------- A8, X4

def record_json(code="country_code", name="country_name", year="year", value="value") -> Column:
    """One chat record as compact JSON; the value is printed with four
    decimals so its length does not depend on the engine's float printing."""
    head = F.to_json(F.struct(F.col(code).alias("country_code"), F.col(name).alias("country_name")))
    return F.concat(F.regexp_replace(head, r"\}$", ""),
                    F.lit(',"year":'), F.col(year).cast("string"),
                    F.lit(',"value":'), F.format_string("%.4f", F.col(value)), F.lit("}"))


def budgeted_context(selection: DataFrame, request_keys=("request_id",), indicator: str = "indicator_id",
                     max_rows: int = MAX_ROWS_PER_INDICATOR, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Per request, decide between raw records, compact summaries and
    rejection.  ``selection`` holds the panel rows each request selected
    (request keys + panel columns).

    Rows > ``max_rows`` for any indicator -> 'reject'; otherwise the request's
    serialised records (sum of record lengths plus separators) within
    ``max_chars`` -> 'raw'; else 'summary' while the summaries (one compact
    JSON object per indicator) fit, else 'reject'.  One partial + final aggregate per
    (request, indicator), then one per request; no record list is built
    here, so a request never becomes one large collected group."""
    keys = list(request_keys)
    per_ind = selection.groupBy(*keys, indicator).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.char_length(record_json())).alias("rec_chars"),
        F.countDistinct("country_code").alias("country_count"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    # records of one indicator: '[' + records joined by ',' + ']'
    per_ind = per_ind.withColumn("chars", F.col("rec_chars") + F.col("n_rows") + 1) \
        .withColumn("sum_chars", F.char_length(F.to_json(F.struct(
            indicator, "n_rows", "country_count", "year_min", "year_max", "value_min", "value_max"))) + 1)
    per_req = per_ind.groupBy(*keys).agg(
        F.max("n_rows").alias("max_rows"), F.sum("chars").alias("n_chars"),
        F.sum("sum_chars").alias("sum_chars"), F.sum("n_rows").alias("n_rows"))
    decision = (F.when(F.col("max_rows") > max_rows, F.lit("reject"))
                 .when(F.col("n_chars") <= max_chars, F.lit("raw"))
                 .when(F.col("sum_chars") + 1 <= max_chars, F.lit("summary"))
                 .otherwise(F.lit("reject")))
    return per_ind.drop("chars", "rec_chars", "sum_chars").join(
        per_req.select(*keys, decision.alias("decision"), F.col("n_chars").cast("bigint").alias("n_chars")), keys)


def selected_ranking(selection: DataFrame, request_keys=("request_id",), rank_start: int = 1,
                     rank_end: int | None = None, ascending: bool = False, value: str = "value",
                     tie: str = "country_code") -> DataFrame:
    """X4's selected ranking (W2 per request): within each request's
    selection, positional ranks [rank_start, rank_end] by value (missing
    last either way), ties by ``tie``.  The upper bound lets Spark put a
    per-group limit (WindowGroupLimit) below the window."""
    rank_end = rank_start + 9 if rank_end is None else rank_end
    if not 1 <= rank_start <= rank_end <= MAX_RANK:
        raise ValueError(f"rank range must satisfy 1 <= start <= end <= {MAX_RANK}")
    o = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    w = Window.partitionBy(*request_keys).orderBy(o, F.col(tie))
    return (selection.withColumn("rank", F.row_number().over(w))
                     .where(F.col("rank").between(rank_start, rank_end))
                     .withColumn("rank", F.col("rank").cast("bigint")))


def selected_correlation(selection: DataFrame, id_a: str, id_b: str, request_keys=("request_id",),
                         year: int | None = None) -> DataFrame:
    """X4's selected correlation (A2 per request): over each request's
    selected countries, Pearson r of the two indicators' country means (each
    on its own years; or one year's values), rounded to 4; ``n`` countries
    with both; NULL r for n < 2 or zero variance.  Both means come from one
    conditional aggregate per (request, country): no pair rows."""
    from tabulon.functions.numeric import safe_pearson
    keys = list(request_keys)
    sel = selection if year is None else selection.where(F.col("year") == year)
    ind = F.col("indicator_id")
    per_country = sel.groupBy(*keys, "country_code").agg(
        F.avg(F.when(ind == id_a, F.col("value"))).alias("x"),
        F.avg(F.when(ind == id_b, F.col("value"))).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    return per_country.groupBy(*keys).agg(F.count(x).cast("bigint").alias("n"),
                                          F.round(safe_pearson(x, y), 4).alias("correlation"))
