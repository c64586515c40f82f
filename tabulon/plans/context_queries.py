"""Composed chat contexts (X4 with A4 and A8) over ``conversations``,
``customer`` and ``orders``.

Every conversation is a request: its id chooses the mode, the indicators, up
to 50 customers (every fourth conversation: all of them), year, rank range and
order.  The panel is the customer-year panel.  One query has the reference's
limits; the other has small ones, so that raw records, summaries and both
rejections occur on small tables too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import context as C
from tabulon.operators.dialog import MAX_CONTEXT_CHARS, MAX_ROWS_PER_INDICATOR
from tabulon.plans.derive import ORDER_REGISTRY_SQL, order_registry
from tabulon.plans.dialog_queries import CUSTOMER_NATION_SQL, _customer_nation_panel
from tabulon.plans.registry import register
from tabulon.session import cut_lineage
from tabulon.sources.testdata import table

SMALL_ROWS, SMALL_CHARS = 700, 6_000


def _requests(spark, sf):
    cid = F.col("conv_id")
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    codes = F.transform(F.sequence(F.lit(1), (1 + cid % 50).cast("int")),
                        lambda i: F.concat(F.lit("c"), ((cid * 7 + i * 3) % 1500).cast("string")))
    mode = F.element_at(F.array(F.lit("trend"), F.lit("rankings"), F.lit("correlation")), (cid % 3 + 1).cast("int"))
    return ids.select(
        "conv_id", mode.alias("mode"),
        F.when(mode == "correlation", F.array(F.lit("revenue"), F.lit("n_orders")))
        .when(cid % 7 == 0, F.array(F.lit("n_orders"))).otherwise(F.array(F.lit("revenue"))).alias("indicators"),
        F.when(cid % 4 == 0, F.array().cast("array<string>")).otherwise(codes).alias("countries"),
        F.when(cid % 5 != 0, (1992 + cid % 7)).cast("int").alias("year"),
        F.when(cid % 2 == 0, 1 + cid % 6).cast("int").alias("rank_start"), F.lit(None).cast("int").alias("rank_end"),
        F.when(cid % 8 < 4, F.lit("asc")).when(cid % 8 < 6, F.lit("desc")).alias("order_dir"))


def _context_sql(max_rows: int, max_chars: int) -> str:
    rec = ("'{{\"country_code\":\"' || {p}country_code || '\",\"country_name\":\"' || {p}country_name || '\",\"year\":' || {p}year "
           "|| ',\"value\":' || printf('%.4f', {p}value) || '}}'")
    body = rec.format(p="s.")[2:]
    return "WITH " + CUSTOMER_NATION_SQL + f""",
reg AS ({ORDER_REGISTRY_SQL}),
q AS (SELECT conv_id, ['trend', 'rankings', 'correlation'][conv_id % 3 + 1] AS mode,
    CASE WHEN conv_id % 3 = 2 THEN ['revenue', 'n_orders'] WHEN conv_id % 7 = 0 THEN ['n_orders'] ELSE ['revenue'] END AS inds,
    CASE WHEN conv_id % 4 = 0 THEN [] ELSE list_transform(generate_series(1, 1 + conv_id % 50),
      lambda i: 'c' || CAST((conv_id * 7 + i * 3) % 1500 AS VARCHAR)) END AS codes,
    CASE WHEN conv_id % 5 <> 0 THEN CAST(1992 + conv_id % 7 AS INTEGER) END AS yr,
    CASE WHEN conv_id % 2 = 0 THEN 1 + conv_id % 6 ELSE 1 END AS rs,
    CASE WHEN conv_id % 8 < 4 THEN 'asc' ELSE 'desc' END AS dir, conv_id % 8 < 6 AS named
  FROM (SELECT DISTINCT conv_id FROM conversations)),
qi AS (SELECT conv_id, pos - 1 AS slot, inds[pos] AS ind, codes, yr FROM (SELECT *, unnest(generate_series(1, len(inds))) AS pos FROM q)),
lst AS (SELECT DISTINCT conv_id, slot, ind, yr, upper(code) AS code FROM (SELECT conv_id, slot, ind, yr, unnest(codes) AS code FROM qi)),
sel AS (SELECT l.conv_id, l.slot, l.ind, l.yr, p.country_code, p.country_name, p.year, p.value
        FROM lst l JOIN cpanel p ON p.indicator_id = l.ind AND p.country_code = l.code
        UNION ALL
        SELECT i.conv_id, i.slot, i.ind, i.yr, p.country_code, p.country_name, p.year, p.value
        FROM qi i JOIN cpanel p ON p.indicator_id = i.ind WHERE len(i.codes) = 0),
s AS (SELECT * FROM sel s),
cnt AS (SELECT i.conv_id, i.slot, i.ind, i.yr, count(s.country_code) AS n, count(DISTINCT s.country_code) AS nc, min(s.year) AS y0, max(s.year) AS y1,
          min(s.value) AS v0, max(s.value) AS v1,
          coalesce('[' || string_agg({rec.format(p='s.')}, ',' ORDER BY s.country_code, s.year, s.value) || ']', '[]') AS records
        FROM qi i LEFT JOIN s ON s.conv_id = i.conv_id AND s.slot = i.slot GROUP BY i.conv_id, i.slot, i.ind, i.yr),
top AS (SELECT conv_id, slot, '[' || string_agg({rec.format(p='s.')}, ',' ORDER BY k) || ']' AS top
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, slot ORDER BY value DESC NULLS LAST, country_code) AS k
              FROM s WHERE year = yr) s WHERE k <= {C.TOP_RECORDS} GROUP BY conv_id, slot),
rk AS (SELECT s.*, q.rs, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.value IS NULL,
           CASE WHEN q.dir = 'asc' THEN s.value ELSE -s.value END, s.country_code) AS k
       FROM s JOIN q ON q.conv_id = s.conv_id AND q.mode = 'rankings' WHERE s.year = s.yr),
rank AS (SELECT conv_id, '[' || string_agg('{{"rank":' || k || ',' || '{body}, ',' ORDER BY k) || ']' AS ranking
         FROM rk s WHERE k BETWEEN rs AND rs + 9 GROUP BY conv_id),
pts AS (SELECT conv_id, country_code, min(CASE WHEN slot = 0 THEN country_name END) AS name,
          avg(CASE WHEN slot = 0 THEN value END) AS x, avg(CASE WHEN slot = 1 THEN value END) AS y
        FROM s WHERE conv_id % 3 = 2 AND (yr IS NULL OR year = yr) GROUP BY conv_id, country_code),
cor AS (SELECT conv_id, '{{"n":' || count(*) || ',"correlation":' || coalesce(CASE WHEN count(*) >= 2 AND stddev_samp(x) * stddev_samp(y) <> 0
            THEN printf('%.4f', covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y))) END, 'null') || ',"points":' ||
          CASE WHEN count(*) >= 2 THEN '[' || string_agg('{{"country_code":"' || country_code || '","country_name":"' || name || '","x":'
            || printf('%.4f', x) || ',"y":' || printf('%.4f', y) || '}}', ',' ORDER BY country_code) || ']' ELSE '[]' END || '}}' AS cor
        FROM pts WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY conv_id),
api AS (SELECT c.conv_id, max(c.n) AS widest, string_agg(ab, ',' ORDER BY c.slot) AS abouts,
          string_agg('{{"indicator":' || ab || ',"indicator_id":"' || ind || '","records":' || records || '}}', ',' ORDER BY c.slot) AS raw,
          string_agg('{{"indicator":' || ab || ',"indicator_id":"' || ind || '","row_count":' || n || ',"country_count":' || nc || ',"year_min":'
            || coalesce(CAST(y0 AS VARCHAR), 'null') || ',"year_max":' || coalesce(CAST(y1 AS VARCHAR), 'null')
            || CASE WHEN n > 0 THEN ',"value_min":' || printf('%.4f', v0) || ',"value_max":' || printf('%.4f', v1) ELSE '' END
            || CASE WHEN yr IS NOT NULL THEN ',"selected_year":' || yr || ',"selected_year_top_records":' || coalesce(top.top, '[]') ELSE '' END
            || '}}', ',' ORDER BY c.slot) AS summary
        FROM (SELECT cnt.*, '{{"id":"' || id || '","label":"' || label || '","unit":"' || unit || '","source":"' || source || '"}}' AS ab
              FROM cnt JOIN reg ON cnt.ind = reg.id) c LEFT JOIN top ON top.conv_id = c.conv_id AND top.slot = c.slot GROUP BY c.conv_id),
head AS (SELECT q.conv_id, api.widest, api.raw, api.summary,
    '{{"mode":"' || mode || '","filters":{{"countries":[' || array_to_string(list_transform(codes, lambda c: '"' || c || '"'), ',') || ']'
    || CASE WHEN yr IS NOT NULL THEN ',"year":' || yr ELSE '' END
    || CASE WHEN q.conv_id % 2 = 0 THEN ',"rank_start":' || rs ELSE '' END
    || CASE WHEN named THEN ',"order":"' || dir || '"' ELSE '' END || '}},"indicators":[' || abouts || '],"selected_ranking":'
    || coalesce(ranking, '[]') || ',"selected_correlation":' || coalesce(cor, 'null') || ',"api_data":[' AS head
  FROM q JOIN api USING (conv_id) LEFT JOIN rank USING (conv_id) LEFT JOIN cor USING (conv_id)),
ctx AS (SELECT conv_id, widest, head || raw || ']}}' AS raw, head || summary || '],"context_note":"{C.CONTEXT_NOTE}"}}' AS summary FROM head),
dec AS (SELECT conv_id, CASE WHEN widest > {max_rows} THEN 'reject_rows' WHEN length(raw) <= {max_chars} THEN 'raw'
          WHEN length(summary) <= {max_chars} THEN 'summary' ELSE 'reject_size' END AS decision, raw, summary FROM ctx),
fin AS (SELECT conv_id, decision, CASE decision WHEN 'raw' THEN raw WHEN 'reject_rows' THEN NULL ELSE summary END AS text FROM dec)
SELECT conv_id, decision, CAST(length(text) AS BIGINT) AS n_chars,
  CASE WHEN decision IN ('raw', 'summary') THEN md5(text) END AS context_md5,
  CASE WHEN decision IN ('raw', 'summary') THEN CAST(json_array_length(text, '$.selected_ranking') AS INTEGER) END AS n_ranked,
  CASE WHEN decision IN ('raw', 'summary') THEN CAST(json_array_length(text, '$.selected_correlation.points') AS INTEGER) END AS n_points,
  CASE WHEN decision = 'raw' THEN CAST(json_array_length(text, '$.api_data[0].records') AS INTEGER) END AS n_records,
  CASE WHEN decision = 'summary' THEN CAST(json_array_length(text, '$.api_data[0].selected_year_top_records') AS INTEGER) END AS n_top,
  CASE WHEN decision = 'summary' THEN CAST(json_extract_string(text, '$.api_data[0].row_count') AS BIGINT) END AS row_count
FROM fin"""


def _digest(out):
    """Fields read back from the composed text."""
    def size(path: str):
        return F.json_array_length(F.get_json_object("context", path))
    raw = F.col("decision") == C.RAW
    return out.select("conv_id", "decision", "n_chars", F.md5("context").alias("context_md5"),
                      size("$.selected_ranking").alias("n_ranked"), size("$.selected_correlation.points").alias("n_points"),
                      F.when(raw, size("$.api_data[0].records")).alias("n_records"),
                      F.when(~raw, size("$.api_data[0].selected_year_top_records")).alias("n_top"),
                      F.when(~raw, F.get_json_object("context", "$.api_data[0].row_count").cast("bigint")).alias("row_count"))


def _compose(spark, sf, *limits):
    panel = cut_lineage(_customer_nation_panel(spark, sf))  # in place of a stored panel
    return _digest(C.chat_context(_requests(spark, sf), panel, order_registry(spark), ("conv_id",), *limits))


@register("dialog_chat_context", _context_sql(MAX_ROWS_PER_INDICATOR, MAX_CONTEXT_CHARS))
def dialog_chat_context(spark, sf):
    """One composed JSON context a request, within the reference's limits."""
    return _compose(spark, sf)


@register("dialog_chat_context_budget", _context_sql(SMALL_ROWS, SMALL_CHARS))
def dialog_chat_context_budget(spark, sf):
    """X4 with small limits: raw records, summaries with the year's top records (A4), both rejections."""
    return _compose(spark, sf, SMALL_ROWS, SMALL_CHARS)
