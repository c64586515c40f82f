"""Dialog queries over ``conversations`` and ``events`` (F7, W5, W6, N20,
N21, N22, X1, J9, J10, A8, X4).

Inputs are derived by Spark from the tables:

* history / messages: the conversation turns themselves; the current message
  of a conversation is its latest user turn, the submitted history the whole
  stored conversation (so W6 appends only when the conversation ends with a
  reply).  The history window is 4 items, because the longest generated
  conversation has 8 turns and the reference's 12 would never cut.
* requests (N21): one per conversation, fields computed from its last turn
  and its turn count; the history rules aggregate over the turns (no
  per-conversation list is collected).
* records (N20): one JSON record per event, shaped by event type so every
  rule fires (string / boolean / null / over-long name / unknown key only).
* commands (X1): each user turn's whole text followed by one command phrase
  chosen and filled from the row's keys, with the reference's indicator
  registry and region groups as the alias dimensions.
* budget (A8): region requests over a customer-year panel that carries the
  customer's nation; the reference's limits (12,000 rows, 400,000 chars).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.text import py_strip
from tabulon.operators import dialog as D
from tabulon.plans.derive import nation_code, nation_region_bridge, BRIDGE_SQL
from tabulon.plans.registry import register
from tabulon.sources.dims import HEALTH_INDICATORS, REGION_GROUPS
from tabulon.sources.testdata import table

HISTORY_N = 4
REGISTRY_IDS = [r[0] for r in HEALTH_INDICATORS]
STRIP_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _strip_sql(c):
    return STRIP_SQL.format(c)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list_sql(items) -> str:
    return "[" + ", ".join(_sq(i) for i in items) + "]"


# ------------------------------------------------------------- F7, W5, W6

@register("dialog_turn_filter", f"""
SELECT conv_id, turn, role, text FROM conversations
WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND {_strip_sql('text')} <> ''""")
def dialog_turn_filter(spark, sf):
    """user/assistant turns with non-blank text."""
    return D.turn_filter(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


HISTORY_SQL = f"""
last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
hist AS (SELECT conv_id, turn, role, substring({_strip_sql('text')}, 1, 800) AS content FROM last
         WHERE rn <= {HISTORY_N} AND role IN ('user', 'assistant') AND text IS NOT NULL
           AND {_strip_sql('text')} <> '')"""


@register("dialog_history", "WITH " + HISTORY_SQL + "\nSELECT conv_id, turn, role, content FROM hist")
def dialog_history(spark, sf):
    """Last 4 items by position, then role/blank filter, trim, cut."""
    return D.clean_history(table(spark, sf, "conversations"), n=HISTORY_N).select("conv_id", "turn", "role",
                                                                                   "content")


def _current(spark, sf):
    conv = table(spark, sf, "conversations")
    return (conv.where(F.col("role") == "user")
                .groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
                .select("conv_id", py_strip(F.col("text")).alias("message")))


@register("dialog_messages", "WITH " + HISTORY_SQL + f""",
cur AS (SELECT conv_id, {_strip_sql('arg_max(text, turn)')} AS message FROM conversations
        WHERE role = 'user' GROUP BY conv_id),
lastc AS (SELECT conv_id, arg_max(content, turn) AS lc FROM hist GROUP BY conv_id),
allm AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, content FROM hist
         UNION ALL
         SELECT c.conv_id, CAST(1073741824 AS BIGINT), 'user', c.message FROM cur c LEFT JOIN lastc l USING (conv_id)
         WHERE l.lc IS NULL OR l.lc <> c.message)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position, role, content
FROM allm""")
def dialog_messages(spark, sf):
    """Cleaned history plus the current message unless it repeats the
    last kept item."""
    hist = D.clean_history(table(spark, sf, "conversations"), n=HISTORY_N)
    return D.history_with_current(hist, _current(spark, sf)).select("conv_id", "position", "role", "content")


@register("dialog_message_check", f"""
SELECT conv_id, turn, CAST(char_length({_strip_sql('text')}) AS INTEGER) AS n_chars,
       CASE WHEN text IS NULL OR {_strip_sql('text')} = '' THEN 'empty'
            WHEN char_length({_strip_sql('text')}) > 800 THEN 'too_long' ELSE 'ok' END AS status
FROM conversations""")
def dialog_message_check(spark, sf):
    """N21, second rule set: trimmed message non-empty and <= 800 chars."""
    m = D.message_check(table(spark, sf, "conversations"))
    return m.select("conv_id", "turn", F.char_length("message").alias("n_chars"), "status")


# -------------------------------------------------------------------- N20

def _event_records(spark, sf):
    e = table(spark, sf, "events")
    code = F.concat(F.lit('"country_code":"U'), F.col("user_id").cast("string"), F.lit('"'))
    year = F.concat(F.lit(',"year":'), F.year("ts").cast("string"))
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    k = F.regexp_extract("props", r"(\d+)", 1)
    t = F.col("event_type")
    rec = (F.when(t == "view", F.concat(F.lit("{"), code, year, F.lit(',"value":'), cents, F.lit(',"k":'), k,
                                        F.lit("}")))
            .when(t == "click", F.concat(F.lit("{"), code, F.lit(',"rank":true}')))
            .when(t == "error", F.concat(F.lit("{"), code, F.lit(',"value":"'), cents, F.lit('"}')))
            .when(t == "signup", F.concat(F.lit('{"country_name":"'), F.repeat(F.lit("n"), F.length(cents)
                                                                             * F.lit(40)), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"x":null}'))))
    return e.select("event_id", rec.alias("record"))


EVENT_RECORDS_SQL = """
recs AS (SELECT event_id, CASE event_type
  WHEN 'view' THEN '{"country_code":"U' || CAST(user_id AS VARCHAR) || '","year":' || CAST(year(ts) AS VARCHAR)
       || ',"value":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',"k":'
       || regexp_extract(props, '(\\d+)', 1) || '}'
  WHEN 'click' THEN '{"country_code":"U' || CAST(user_id AS VARCHAR) || '","rank":true}'
  WHEN 'error' THEN '{"country_code":"U' || CAST(user_id AS VARCHAR) || '","value":"'
       || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '"}'
  WHEN 'signup' THEN '{"country_name":"' || repeat('n', length(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR))
       * 40) || '"}'
  ELSE '{"k":' || regexp_extract(props, '(\\d+)', 1) || ',"x":null}' END AS record FROM events)"""


def _record_check_sql() -> str:
    def typ(k):
        return f"json_type(record, '$.{k}')"
    present = [f"({typ(k)} IS NOT NULL)" for k in D.RECORD_KEYS]
    oks = []
    for k in D.RECORD_KEYS:
        if k in D.RECORD_NAME_KEYS:
            oks.append(f"({typ(k)} = 'VARCHAR' AND length(json_extract_string(record, '$.{k}')) <= 120)")
        else:
            oks.append(f"({typ(k)} IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND "
                       f"isfinite(CAST(json_extract(record, '$.{k}') AS DOUBLE)))")
    n_known = " + ".join(f"CAST({p} AS INTEGER)" for p in present)
    bad = "COALESCE(" + ", ".join(f"CASE WHEN {p} AND NOT {o} THEN '{k}' END"
                                  for k, p, o in zip(D.RECORD_KEYS, present, oks)) + ")"
    return f"""WITH {EVENT_RECORDS_SQL},
chk AS (SELECT event_id, record, CAST({n_known} AS INTEGER) AS n_known, {bad} AS bad_key FROM recs)
SELECT event_id, n_known, bad_key, n_known > 0 AND bad_key IS NULL AS valid FROM chk"""


@register("dialog_record_check", _record_check_sql())
def dialog_record_check(spark, sf):
    """Whitelist check of one JSON record per event."""
    return D.record_check(_event_records(spark, sf)).select("event_id", "n_known", "bad_key", "valid")


# -------------------------------------------------------------------- N21

IDS_PLUS = REGISTRY_IDS + ["unknown_metric"]


def _requests(spark, sf):
    conv = table(spark, sf, "conversations")
    last = conv.groupBy("conv_id").agg(F.max_by("text", "turn").alias("message"),
                                       F.max("turn").alias("last_turn"),
                                       F.count(F.lit(1)).alias("n_turns"))
    ids = F.array(*[F.lit(i) for i in IDS_PLUS])
    n_ids = len(IDS_PLUS)
    mode = F.element_at(F.array(*[F.lit(m) for m in ("trend", "rankings", "correlation", "compare")]),
                        (F.col("conv_id") % 4 + 1).cast("int"))
    first = F.element_at(ids, (F.col("conv_id") % n_ids + 1).cast("int"))
    second = F.element_at(ids, (F.floor(F.col("conv_id") / n_ids) % n_ids + 1).cast("int"))
    words = F.filter(F.split(F.lower(F.col("message")), "[^a-z]+"), lambda w: F.length(w) == 3)
    req = last.select(
        "conv_id", "message", mode.alias("mode"),
        F.when(mode == "correlation", F.array(first, second)).otherwise(F.array(first)).alias("indicators"),
        F.array_distinct(words).alias("countries"),
        (1990 + F.col("conv_id") % 40).cast("int").alias("year"),
        F.lit(None).cast("int").alias("top_n"),
        F.col("n_turns").cast("int").alias("rank_start"),
        (F.char_length("message") * 30).cast("int").alias("rank_end"),
        F.element_at(F.array(F.lit("asc"), F.lit("desc"), F.lit("up")),
                     (F.col("conv_id") % 3 + 1).cast("int")).alias("order_dir"),
        F.floor(F.char_length("message") / 3).cast("int").alias("n_rows"),
        F.lit(0).alias("n_points"), F.col("n_turns").cast("int").alias("n_statistics"),
        "last_turn")
    hist = (conv.join(last.select("conv_id", "last_turn"), "conv_id")
                .where(F.col("turn") < F.col("last_turn"))
                .select("conv_id", "role", F.col("text").alias("content")))
    return req.drop("last_turn"), hist


@register("dialog_request_check", f"""
WITH last AS (SELECT conv_id, arg_max(text, turn) AS message, max(turn) AS last_turn, count(*) AS n_turns
              FROM conversations GROUP BY conv_id),
req AS (
  SELECT conv_id, message,
         ['trend', 'rankings', 'correlation', 'compare'][conv_id % 4 + 1] AS mode,
         CASE WHEN ['trend', 'rankings', 'correlation', 'compare'][conv_id % 4 + 1] = 'correlation'
              THEN [{_list_sql(IDS_PLUS)}[conv_id % {len(IDS_PLUS)} + 1],
                    {_list_sql(IDS_PLUS)}[(conv_id // {len(IDS_PLUS)}) % {len(IDS_PLUS)} + 1]]
              ELSE [{_list_sql(IDS_PLUS)}[conv_id % {len(IDS_PLUS)} + 1]] END AS indicators,
         list_distinct(list_filter(string_split_regex(lower(message), '[^a-z]+'),
                                           lambda w: length(w) = 3)) AS countries,
         n_turns AS rank_start, length(message) * 30 AS rank_end,
         ['asc', 'desc', 'up'][conv_id % 3 + 1] AS order_dir,
         length(message) // 3 AS n_rows, n_turns AS n_statistics, last_turn
  FROM last),
hist AS (
  SELECT c.conv_id, count(*) AS n_hist,
         bool_and(role IN ('user', 'assistant') AND text IS NOT NULL AND {_strip_sql('text')} <> ''
                  AND length({_strip_sql('text')}) <= 1000) AS hist_ok
  FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn < l.last_turn GROUP BY c.conv_id),
chk AS (
  SELECT r.*, coalesce(h.n_hist, 0) AS n_hist, coalesce(h.hist_ok, true) AS hist_ok FROM req r
  LEFT JOIN hist h USING (conv_id))
SELECT conv_id,
  CASE WHEN message IS NULL OR {_strip_sql('message')} = '' OR length({_strip_sql('message')}) > 1000 THEN 'message'
       WHEN mode NOT IN ('trend', 'rankings', 'correlation') THEN 'mode'
       WHEN len(indicators) > 2 OR NOT list_bool_and(list_transform(indicators,
            lambda i: list_contains({_list_sql(REGISTRY_IDS)}, i))) THEN 'indicators'
       WHEN len(indicators) <> (CASE WHEN mode = 'correlation' THEN 2 ELSE 1 END)
            OR len(list_distinct(indicators)) <> len(indicators) THEN 'indicator_count'
       WHEN len(countries) > 50 OR NOT coalesce(list_bool_and(list_transform(countries,
            lambda c: regexp_full_match(upper(c), '[A-Z0-9_-]{{1,12}}'))), true) THEN 'countries'
       WHEN abs(rank_start) > 10000 OR abs(rank_end) > 10000 THEN 'integers'
       WHEN order_dir NOT IN ('asc', 'desc') THEN 'order'
       WHEN n_rows > 120 OR n_statistics > 8 THEN 'snapshot'
       WHEN n_hist > 8 OR NOT hist_ok THEN 'history' END AS reason,
  CAST(len(countries) AS INTEGER) AS n_countries
FROM chk""")
def dialog_request_check(spark, sf):
    """Chat request rule set, first failing rule per request."""
    req, hist = _requests(spark, sf)
    out = D.request_check(req, REGISTRY_IDS, history_turns=hist)
    return out.select("conv_id", "reason", F.size("countries").cast("int").alias("n_countries"))


# ------------------------------------------------------------ X1, J9, J10

LABELS = [r[1] for r in HEALTH_INDICATORS]
REGIONS = list(REGION_GROUPS)


def _command_messages(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    cid, turn = F.col("conv_id"), F.col("turn")
    lab = F.when(turn % 2 == 0, F.lower(F.element_at(F.array(*[F.lit(x) for x in LABELS]),
                                                     (cid % 8 + 1).cast("int")))) \
           .otherwise(F.regexp_replace(F.element_at(F.array(*[F.lit(x) for x in REGISTRY_IDS]),
                                                    (cid % 8 + 1).cast("int")), "_", " "))
    reg = F.element_at(F.array(*[F.lit(x) for x in REGIONS]), ((cid + turn) % len(REGIONS) + 1).cast("int"))
    y1 = (1990 + cid % 25).cast("string")
    y2 = (1990 + cid % 25 + turn).cast("string")
    a = turn.cast("string")
    b = (turn + cid % 12 - 2).cast("string")
    phrase = F.element_at(F.array(
        F.concat(F.lit("show ranks "), a, F.lit(" to "), b, F.lit(" for "), lab, F.lit(" in "), y2),
        F.concat(F.lit("compare "), reg, F.lit(" on "), lab),
        F.concat(F.lit("trend of "), lab, F.lit(" between "), y1, F.lit(" and "), y2),
        F.concat(F.lit("rank "), a, F.lit(" through "), b),
        F.lit(""),
        F.concat(F.lit("from "), y1, F.lit(" to "), y2, F.lit(" in "), reg)), ((cid + turn) % 6 + 1).cast("int"))
    return conv.select(
        "conv_id", "turn", F.concat(F.col("text"), F.lit(" "), phrase).alias("message"),
        F.element_at(F.array(*[F.lit(x) for x in REGISTRY_IDS]), ((cid * 5) % 8 + 1).cast("int"))
         .alias("context_indicator"),
        (2000 + turn).cast("int").alias("context_year"))


COMMAND_MESSAGES_SQL = f"""
msgs AS (
  SELECT conv_id, turn,
         text || ' ' || [
           'show ranks ' || CAST(turn AS VARCHAR) || ' to ' || CAST(turn + conv_id % 12 - 2 AS VARCHAR) || ' for '
             || lab || ' in ' || CAST(1990 + conv_id % 25 + turn AS VARCHAR),
           'compare ' || reg || ' on ' || lab,
           'trend of ' || lab || ' between ' || CAST(1990 + conv_id % 25 AS VARCHAR) || ' and '
             || CAST(1990 + conv_id % 25 + turn AS VARCHAR),
           'rank ' || CAST(turn AS VARCHAR) || ' through ' || CAST(turn + conv_id % 12 - 2 AS VARCHAR),
           '',
           'from ' || CAST(1990 + conv_id % 25 AS VARCHAR) || ' to ' || CAST(1990 + conv_id % 25 + turn AS VARCHAR)
             || ' in ' || reg][(conv_id + turn) % 6 + 1] AS message,
         {_list_sql(REGISTRY_IDS)}[(conv_id * 5) % 8 + 1] AS context_indicator,
         CAST(2000 + turn AS INTEGER) AS context_year
  FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN lower({_list_sql(LABELS)}[conv_id % 8 + 1])
                       ELSE replace({_list_sql(REGISTRY_IDS)}[conv_id % 8 + 1], '_', ' ') END AS lab,
               {_list_sql(REGIONS)}[(conv_id + turn) % {len(REGIONS)} + 1] AS reg
        FROM conversations WHERE role = 'user'))"""


def _pick_sql(low: str, entries) -> str:
    items = ", ".join("{'v': " + _sq(v) + ", 'a': " + _list_sql(a) + "}" for v, a in entries)
    return (f"list_filter([{items}], lambda e: list_bool_or(list_transform(e.a, lambda x: contains({low}, x))))"
            "[1].v")


def _as_int_sql(d: str) -> str:
    t = f"regexp_replace({d}, '^0+(\\d)', '\\1')"
    return f"CASE WHEN length({t}) > 9 THEN 1000000000 ELSE TRY_CAST({t} AS INTEGER) END"


RANK_SQL_RE = "\\branks?\\s+(\\d+)\\s*(?:to|through|-)\\s*(\\d+)\\b"
RANGE_SQL_RE = "\\b(?:between|from)\\s+(19\\d{2}|20\\d{2})\\s+(?:and|to)\\s+(19\\d{2}|20\\d{2})\\b"
YEAR_SQL_RE = "\\bin\\s+(19\\d{2}|20\\d{2})\\b"

COMMANDS_SQL = "WITH " + COMMAND_MESSAGES_SQL + f""",
low AS (SELECT conv_id, turn, lower(message) AS low, context_indicator, context_year FROM msgs),
p AS (
  SELECT conv_id, turn, low,
         coalesce({_pick_sql('low', D.indicator_aliases(HEALTH_INDICATORS))}, context_indicator) AS ind,
         {_pick_sql('low', D.region_aliases(REGION_GROUPS))} AS region,
         regexp_matches(low, '{RANK_SQL_RE}') AS has_rank,
         {_as_int_sql(f"regexp_extract(low, '{RANK_SQL_RE}', 1)")} AS r_start,
         {_as_int_sql(f"regexp_extract(low, '{RANK_SQL_RE}', 2)")} AS r_end,
         CASE WHEN regexp_matches(low, '{YEAR_SQL_RE}')
              THEN CAST(regexp_extract(low, '{YEAR_SQL_RE}', 1) AS INTEGER) ELSE context_year END AS year,
         regexp_matches(low, '{RANGE_SQL_RE}') AS has_range,
         CAST(nullif(regexp_extract(low, '{RANGE_SQL_RE}', 1), '') AS INTEGER) AS y_min,
         CAST(nullif(regexp_extract(low, '{RANGE_SQL_RE}', 2), '') AS INTEGER) AS y_max,
         contains(low, 'trend') OR contains(low, 'over time') OR contains(low, 'between')
           OR contains(low, 'from') AS trend_word,
         contains(low, 'correlation') OR contains(low, 'compare') AS corr_word
  FROM low),
a AS (
  SELECT conv_id, turn,
    CASE WHEN has_rank THEN CASE WHEN r_start >= 1 AND r_end >= r_start AND r_end <= 1000 AND ind IS NOT NULL
                                 THEN 'rankings' END
         WHEN region IS NOT NULL AND ind IS NOT NULL THEN CASE WHEN corr_word THEN 'correlation' ELSE 'trend' END
         WHEN has_range AND trend_word AND ind IS NOT NULL THEN 'trend' END AS mode,
    has_rank, region, ind, year, r_start, r_end, y_min, y_max
  FROM p)
"""

COMMAND_COLS_SQL = """
  SELECT conv_id, turn, mode, CASE WHEN mode IS NOT NULL THEN ind END AS indicator_id,
         CASE WHEN mode = 'rankings' THEN year END AS year,
         CASE WHEN mode = 'rankings' THEN r_start END AS rank_start,
         CASE WHEN mode = 'rankings' THEN r_end END AS rank_end,
         CASE WHEN mode IN ('correlation', 'trend') AND NOT has_rank AND region IS NOT NULL THEN region END AS region,
         CASE WHEN mode = 'trend' AND region IS NULL THEN y_min END AS year_min,
         CASE WHEN mode = 'trend' AND region IS NULL THEN y_max END AS year_max
  FROM a"""


def _commands(spark, sf):
    return D.extract_command(_command_messages(spark, sf), HEALTH_INDICATORS, REGION_GROUPS)


@register("dialog_commands", COMMANDS_SQL + COMMAND_COLS_SQL)
def dialog_commands(spark, sf):
    """X1 + J9 + J10: deterministic dashboard action per user message."""
    c = _commands(spark, sf)
    return c.select("conv_id", "turn", *[F.col(f"action.{f}").alias(f) for f in
                                         ("mode", "indicator_id", "year", "rank_start", "rank_end", "region",
                                          "year_min", "year_max")])


def _regions_sql() -> str:
    rows = ", ".join(f"({_sq(n)}, {_list_sql(c.split())})" for n, c in REGION_GROUPS.items())
    return f"regions AS (SELECT * FROM (VALUES {rows}) AS t(rname, codes))"


@register("dialog_action_check", COMMANDS_SQL + ", cmd AS (" + COMMAND_COLS_SQL + "), " + _regions_sql() + """
SELECT conv_id, turn,
       mode IS NOT NULL AND mode <> 'correlation' AS valid,
       CASE WHEN mode IS NOT NULL AND mode <> 'correlation' THEN mode END AS valid_mode,
       CASE WHEN mode IS NOT NULL AND mode <> 'correlation' THEN rank_start END AS valid_rank_start,
       CASE WHEN mode IS NOT NULL AND mode <> 'correlation' THEN array_to_string(r.codes, ',') END AS country_codes
FROM cmd LEFT JOIN regions r ON cmd.region = r.rname""")
def dialog_action_check(spark, sf):
    """N22 over the extracted actions: a correlation action without x/y ids
    is rejected; a region expands to its codes."""
    c = D.action_check(_commands(spark, sf), REGISTRY_IDS, REGION_GROUPS)  # a NULL action gives a NULL verdict
    va = F.col("valid_action")
    return c.select("conv_id", "turn", va.isNotNull().alias("valid"), va["mode"].alias("valid_mode"),
                    va["rank_start"].alias("valid_rank_start"),
                    F.array_join(va["country_codes"], ",").alias("country_codes"))


# ---------------------------------------------------------------- A8, X4

def _customer_nation_panel(spark, sf):
    """Customer-year revenue rows carrying the customer's nation code."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    agg = o.groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"),
                                             F.count(F.lit(1)).cast("double").alias("n_orders"))
    j = agg.join(c, agg.o_custkey == c.c_custkey)
    return j.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("country_code"),
                    F.col("c_name").alias("country_name"), F.col("year").cast("int").alias("year"),
                    nation_code(F.col("c_nationkey")).alias("nation"),
                    F.explode(F.array(F.struct(F.lit("revenue").alias("indicator_id"), F.col("revenue").alias("value")),
                                      F.struct(F.lit("n_orders").alias("indicator_id"),
                                               F.col("n_orders").alias("value")))).alias("m")) \
            .select("country_code", "country_name", "year", "nation", "m.indicator_id", "m.value")


CUSTOMER_NATION_SQL = """
cpanel AS (
  SELECT 'C' || CAST(a.o_custkey AS VARCHAR) AS country_code, c.c_name AS country_name,
         CAST(a.year AS INTEGER) AS year, 'N' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS nation,
         m.indicator_id, m.value
  FROM (SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS revenue,
               CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY o_custkey, year(o_orderdate)) a
  JOIN customer c ON a.o_custkey = c.c_custkey
  CROSS JOIN LATERAL (VALUES ('revenue', a.revenue), ('n_orders', a.n_orders)) AS m(indicator_id, value))"""


def _selection(spark, sf):
    """Rows each region request selects: the panel joined to the bridge on
    the customer's nation (the bridge is bounded by the nation table)."""
    bridge = nation_region_bridge(spark, sf).withColumnRenamed("country_code", "nation")
    return _customer_nation_panel(spark, sf).join(bridge, "nation")


@register("dialog_budget", "WITH " + CUSTOMER_NATION_SQL + f", bridge AS ({BRIDGE_SQL})" + """,
sel AS (SELECT b.region, p.* FROM cpanel p JOIN bridge b ON p.nation = b.country_code),
rec AS (SELECT *, length(to_json({'country_code': country_code, 'country_name': country_name}))
                  - 1 + length(',"year":' || CAST(year AS VARCHAR) || ',"value":' || printf('%.4f', value) || '}')
                  AS rlen FROM sel),
per_ind AS (SELECT region, indicator_id, count(*) AS n_rows, sum(rlen) AS rec_chars,
                   count(DISTINCT country_code) AS country_count, min(year) AS year_min, max(year) AS year_max,
                   min(value) AS value_min, max(value) AS value_max FROM rec GROUP BY region, indicator_id),
per_req AS (SELECT region, max(n_rows) AS max_rows, sum(rec_chars + n_rows + 1) AS n_chars
            FROM per_ind GROUP BY region)
SELECT i.region, i.indicator_id, i.n_rows, i.country_count, i.year_min, i.year_max, i.value_min, i.value_max,
       CASE WHEN r.max_rows > 12000 THEN 'reject' WHEN r.n_chars <= 400000 THEN 'raw' ELSE 'summary' END
         AS decision, CAST(r.n_chars AS BIGINT) AS n_chars
FROM per_ind i JOIN per_req r USING (region)""")
def dialog_budget(spark, sf):
    """Raw / summary / reject per region request over two indicators."""
    out = D.budgeted_context(_selection(spark, sf), request_keys=("region",))
    return out.select("region", "indicator_id", "n_rows", "country_count", "year_min", "year_max",
                      "value_min", "value_max", "decision", "n_chars")


@register("dialog_selected_ranking", "WITH " + CUSTOMER_NATION_SQL + f", bridge AS ({BRIDGE_SQL})" + """,
sel AS (SELECT b.region, p.* FROM cpanel p JOIN bridge b ON p.nation = b.country_code
        WHERE p.indicator_id = 'revenue'),
r AS (SELECT *, row_number() OVER (PARTITION BY region, year ORDER BY value DESC NULLS LAST, country_code) AS rank
      FROM sel)
SELECT region, year, CAST(rank AS BIGINT) AS rank, country_code, country_name, value FROM r
WHERE rank BETWEEN 3 AND 12""")
def dialog_selected_ranking(spark, sf):
    """X4's selected ranking: per (region request, year) the ranks 3..12 of
    the countries the request selected (filter before ranking, W2 range)."""
    sel = _selection(spark, sf).where(F.col("indicator_id") == "revenue")
    out = D.selected_ranking(sel, request_keys=("region", "year"), rank_start=3, rank_end=12)
    return out.select("region", "year", "rank", "country_code", "country_name", "value")


@register("dialog_selected_correlation", "WITH " + CUSTOMER_NATION_SQL + f", bridge AS ({BRIDGE_SQL})" + """,
sel AS (SELECT b.region, p.* FROM cpanel p JOIN bridge b ON p.nation = b.country_code),
pc AS (SELECT region, country_code,
              avg(CASE WHEN indicator_id = 'revenue' THEN value END) AS x,
              avg(CASE WHEN indicator_id = 'n_orders' THEN value END) AS y
       FROM sel GROUP BY region, country_code),
m AS (SELECT region, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x,
             CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM pc)
SELECT region, count(x) AS n,
       round(CASE WHEN stddev_samp(x) * stddev_samp(y) <> 0
                  THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END, 4) AS correlation
FROM m GROUP BY region""")
def dialog_selected_correlation(spark, sf):
    """X4's selected correlation: per region request, Pearson r of revenue
    and order count over the customers it selected (country means)."""
    return D.selected_correlation(_selection(spark, sf), "revenue", "n_orders", request_keys=("region",))
