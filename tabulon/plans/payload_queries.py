"""Chat payloads (N21) over ``conversations``: one JSON payload a conversation,
with its last turn as the message and its first as the history; the id decides
the mode, the indicators, the filters, the lengths of the snapshot's lists and
which of their elements is wrong (the last one, so a check has to get there)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import dialog as D
from tabulon.operators.payload import payload_check
from tabulon.plans.dialog_queries import IDS_PLUS, REGISTRY_IDS, _list_sql, _strip_sql
from tabulon.plans.registry import register
from tabulon.sources.testdata import table


def _payloads(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("message"), F.min_by(F.struct("role", F.col("text").alias("content")), "turn").alias("first"))
    c = F.col("conv_id")

    def number(x):
        return x.cast("string")

    def items(n, one, bad, when):
        """A JSON list of ``n`` elements whose last one is ``bad`` on a condition."""
        each = F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")),
                           lambda i: F.when(when & (i == n), F.lit(bad)).otherwise(one(i)))
        return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))

    ids = F.array(*[F.lit(i) for i in IDS_PLUS])

    def indicator(at):
        label = F.when(c % 17 == 2, F.lit("")).otherwise(F.lit(',"label":"L"'))
        return F.concat(F.lit('{"id":"'), F.get(ids, (at % len(IDS_PLUS)).cast("int")), F.lit('"'), label, F.lit("}"))
    rows = items(1 + c % 123, lambda i: F.concat(F.lit('{"country_code":"C'), number(i), F.lit('","year":2000,"value":'), number(i), F.lit(".5}")),
                 '{"country_code":"C","value":"x"}', c % 7 == 3)
    points = items(c % 5, lambda i: F.concat(F.lit('{"x":'), number(i), F.lit(',"y":'), number(i), F.lit("}")), '{"junk":1}', c % 11 == 4)
    stats = items(c % 10, lambda i: F.concat(F.lit('{"label":"s'), number(i), F.lit('","value":'), number(i), F.lit("}")),
                  '{"label":"s","value":true}', c % 13 == 6)
    text = F.regexp_replace(F.to_json(F.struct(F.coalesce("message", F.lit("")).alias("m"))), r'^\{"m":|\}$', "")
    mode = F.get(F.array(*map(F.lit, ("trend", "rankings", "correlation", "compare"))), (c % 4).cast("int"))
    payload = F.concat(
        F.lit('{"message":'), text, F.lit(',"mode":"'), mode, F.lit('","indicators":['), indicator(c),
        F.when(c % 4 == 2, F.concat(F.lit(","), indicator(F.floor(c / 3)))).otherwise(F.lit("")),
        F.lit('],"filters":{"countries":["usa","DE_1"],"year":'), F.when(c % 9 == 1, F.lit("true")).otherwise(number(1990 + c % 40)),
        F.lit(',"order":"'), F.get(F.array(F.lit("asc"), F.lit("desc"), F.lit("up")), F.when(c % 31 == 0, 2).otherwise((c % 2).cast("int"))),
        F.lit('"},"snapshot":{"rows":'), rows, F.lit(',"points":'), points, F.lit(',"statistics":'), stats, F.lit('},"history":['),
        F.to_json("first"), F.lit("]}"))
    return turns.select("conv_id", payload.alias("payload"))


def _record_sql(r: str) -> str:
    known = " OR ".join(f"json_type({r}, '$.{k}') IS NOT NULL" for k in D.RECORD_KEYS)
    fine = []
    for k in D.RECORD_KEYS:
        ok = (f"json_type({r}, '$.{k}') = 'VARCHAR' AND length({r}->>'$.{k}') <= 120" if k in D.RECORD_NAME_KEYS
              else f"json_type({r}, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
        fine.append(f"(json_type({r}, '$.{k}') IS NULL OR ({ok}))")
    return f"(({known}) AND {' AND '.join(fine)})"


def _all_sql(path: str, rule: str) -> str:
    return f"coalesce(list_bool_and(list_transform(CAST(json_extract(j, '{path}') AS JSON[]), lambda r: {rule})), true)"


PAYLOAD_SQL = f"""
WITH t AS (SELECT conv_id, arg_max(text, turn) AS message, arg_min(role, turn) AS role, arg_min(text, turn) AS content FROM conversations GROUP BY conv_id),
b AS (SELECT *, 1 + conv_id % 123 AS nr, conv_id % 5 AS np, conv_id % 10 AS ns, {_list_sql(IDS_PLUS)} AS ids,
        ['trend', 'rankings', 'correlation', 'compare'][conv_id % 4 + 1] AS mode FROM t),
p AS (SELECT conv_id, CAST(CAST('{{"message":' || to_json(coalesce(message, '')) || ',"mode":"' || mode || '","indicators":['
    || '{{"id":"' || ids[conv_id % {len(IDS_PLUS)} + 1] || '"' || CASE WHEN conv_id % 17 = 2 THEN '' ELSE ',"label":"L"' END || '}}'
    || CASE WHEN conv_id % 4 = 2 THEN ',{{"id":"' || ids[(conv_id // 3) % {len(IDS_PLUS)} + 1] || '"' || CASE WHEN conv_id % 17 = 2 THEN '' ELSE ',"label":"L"' END || '}}' ELSE '' END
    || '],"filters":{{"countries":["usa","DE_1"],"year":' || CASE WHEN conv_id % 9 = 1 THEN 'true' ELSE CAST(1990 + conv_id % 40 AS VARCHAR) END
    || ',"order":"' || ['asc', 'desc', 'up'][CASE WHEN conv_id % 31 = 0 THEN 3 ELSE conv_id % 2 + 1 END] || '"}},"snapshot":{{"rows":['
    || array_to_string(list_transform(generate_series(1, nr), lambda i: CASE WHEN conv_id % 7 = 3 AND i = nr THEN '{{"country_code":"C","value":"x"}}'
         ELSE '{{"country_code":"C' || i || '","year":2000,"value":' || i || '.5}}' END), ',')
    || '],"points":[' || array_to_string(list_transform(generate_series(1, np), lambda i: CASE WHEN conv_id % 11 = 4 AND i = np THEN '{{"junk":1}}'
         ELSE '{{"x":' || i || ',"y":' || i || '}}' END), ',')
    || '],"statistics":[' || array_to_string(list_transform(generate_series(1, ns), lambda i: CASE WHEN conv_id % 13 = 6 AND i = ns THEN '{{"label":"s","value":true}}'
         ELSE '{{"label":"s' || i || '","value":' || i || '}}' END), ',')
    || ']}},"history":[{{"role":' || to_json(role) || ',"content":' || to_json(content) || '}}]}}' AS VARCHAR) AS JSON) AS j FROM b),
x AS (SELECT conv_id, j, {_strip_sql("(j->>'$.message')")} AS message, j->>'$.mode' AS mode, {_strip_sql("(j->>'$.history[0].content')")} AS content,
        json_array_length(j, '$.snapshot.rows') AS n_rows, json_array_length(j, '$.snapshot.points') AS n_points,
        json_array_length(j, '$.snapshot.statistics') AS n_statistics FROM p)
SELECT conv_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_points AS BIGINT) AS n_points, CAST(n_statistics AS BIGINT) AS n_statistics,
  CASE WHEN message = '' OR length(message) > 1000 THEN 'message' WHEN mode NOT IN ('trend', 'rankings', 'correlation') THEN 'mode'
    WHEN NOT {_all_sql("$.indicators", f"list_contains({_list_sql(REGISTRY_IDS)}, r->>'$.id') AND coalesce(r->>'$.label', '') <> ''")} THEN 'indicators'
    WHEN json_array_length(j, '$.indicators') <> CASE WHEN mode = 'correlation' THEN 2 ELSE 1 END
      OR j->>'$.indicators[0].id' = j->>'$.indicators[1].id' THEN 'indicator_count'
    WHEN json_type(j, '$.filters.year') NOT IN ('BIGINT', 'UBIGINT') THEN 'integers'
    WHEN j->>'$.filters.order' NOT IN ('asc', 'desc') THEN 'order'
    WHEN n_rows > 120 OR n_points > 120 OR n_statistics > 8 THEN 'snapshot'
    WHEN NOT {_all_sql("$.snapshot.rows", _record_sql("r"))} THEN 'rows'
    WHEN NOT {_all_sql("$.snapshot.points", _record_sql("r"))} THEN 'points'
    WHEN NOT {_all_sql("$.snapshot.statistics", "json_type(r, '$.value') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')")} THEN 'statistics'
    WHEN j->>'$.history[0].role' NOT IN ('user', 'assistant') OR coalesce(content, '') = '' OR length(content) > 1000 THEN 'history' END AS reason
FROM x"""


@register("dialog_payload_check", PAYLOAD_SQL)
def dialog_payload_check(spark, sf):
    """Every value of one payload a conversation, first failing rule."""
    return payload_check(_payloads(spark, sf), REGISTRY_IDS).select("conv_id", "n_rows", "n_points", "n_statistics", "reason")
