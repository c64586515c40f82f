"""Scoring queries: every supplier is a case whose base ratings and resource
requirements come from its own attributes and its lineitem history; the
scenario grid (27 tier combinations x 3 priorities x 3 weight sets) is swept
over all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import scoring as K
from tabulon.plans.registry import register
from tabulon.sources.testdata import table

WEIGHT_SETS = [[20, 20, 20, 20, 20], [0, 0, 0, 0, 0], [100, 0, 50, 25, 5]]
GRID = K.scenario_grid(WEIGHT_SETS)


def supplier_cases(spark, sf):
    s = table(spark, sf, "supplier")
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_returned"))
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation")
    j = (s.join(li, s.s_suppkey == li.l_suppkey, "left")
          .join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
          .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    nl = F.coalesce(F.col("n_lines"), F.lit(0))
    nr = F.coalesce(F.col("n_returned"), F.lit(0))
    return j.select(
        F.col("s_suppkey").alias("case_id"),
        F.concat(F.lower("r_name"), F.when(F.col("s_acctbal") > 5000, F.lit(" affordability"))
                 .otherwise(F.lit(" access"))).alias("label"),
        F.array((1 + F.col("s_suppkey") % 5), (1 + F.col("s_nationkey") % 5), F.lit(3),
                (1 + F.col("s_nationkey") % 3), (1 + nr % 5)).cast("array<int>").alias("ratings"),
        F.array((1 + F.col("s_suppkey") % 3), (1 + F.floor(F.col("s_suppkey") / 3) % 3),
                (1 + nl % 3)).cast("array<int>").alias("requirements"),
        (F.col("s_acctbal") > 5000).alias("is_supply"),
    )


def _grid_sql():
    rows = ", ".join(f"({sid}, {b}, {s}, {h}, '{p}', {w[0]}, {w[1]}, {w[2]}, {w[3]}, {w[4]})"
                     for sid, b, s, h, p, w in GRID)
    return ("SELECT CAST(scenario_id AS BIGINT) AS scenario_id, budget, staff, horizon, priority, w0, w1, w2, w3, w4 "
            f"FROM (VALUES {rows}) AS g(scenario_id, budget, staff, horizon, priority, w0, w1, w2, w3, w4)")


SWEEP_SQL = f"""
WITH li AS (SELECT l_suppkey, count(*) AS n_lines,
                   sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned
            FROM lineitem GROUP BY l_suppkey),
cases AS (
  SELECT s_suppkey AS case_id,
         lower(r_name) || CASE WHEN s_acctbal > 5000 THEN ' affordability' ELSE ' access' END AS label,
         CAST(1 + s_suppkey % 5 AS DOUBLE) AS r0, CAST(1 + s_nationkey % 5 AS DOUBLE) AS r1,
         1 + s_nationkey % 3 AS r3b, CAST(1 + coalesce(n_returned, 0) % 5 AS DOUBLE) AS r4,
         1 + s_suppkey % 3 AS q0, 1 + (s_suppkey // 3) % 3 AS q1, 1 + coalesce(n_lines, 0) % 3 AS q2,
         s_acctbal > 5000 AS is_supply
  FROM supplier LEFT JOIN li ON s_suppkey = l_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
grid AS ({_grid_sql()}),
x AS (
  SELECT c.*, g.*,
         CASE WHEN budget < q0 OR staff < q1 OR horizon < q2
              THEN least(greatest(1.0, least(5.0, 4.0 + (sign(budget - q0) + sign(staff - q1) + sign(horizon - q2)) / 2.0)), 2.0)
              ELSE greatest(1.0, least(5.0, 4.0 + (sign(budget - q0) + sign(staff - q1) + sign(horizon - q2)) / 2.0)) END AS r2,
         greatest(1.0, least(3.0, CAST(r3b AS DOUBLE) + CASE WHEN priority = 'balanced' THEN 0
              WHEN (priority = 'supply') = is_supply THEN 1 ELSE -1 END)) AS r3
  FROM cases c CROSS JOIN grid g),
scored AS (
  SELECT *, CASE WHEN (((((0.0 + w0) + w1) + w2) + w3) + w4) <> 0 THEN
         CAST(floor((((((0.0 + r0 / 5.0 * w0) + r1 / 5.0 * w1) + r2 / 5.0 * w2) + r3 / 5.0 * w3) + r4 / 5.0 * w4)
                    / (((((0.0 + w0) + w1) + w2) + w3) + w4) * 100.0 + 0.5) AS BIGINT) END AS score
  FROM x)"""


def _sweep(spark, sf):
    return K.sweep(supplier_cases(spark, sf), GRID)


@register("scoring_sweep", SWEEP_SQL + """
SELECT scenario_id, case_id, score, r2 AS capacity, r3 AS feasibility FROM scored""")
def scoring_sweep(spark, sf):
    """K1-K4: score, capacity and feasibility of every case under every scenario."""
    s = _sweep(spark, sf)
    return s.select("scenario_id", "case_id", "score",
                    F.element_at("ratings_now", 3).alias("capacity"),
                    F.element_at("ratings_now", 4).alias("feasibility"))


@register("scoring_best_case", SWEEP_SQL + """
SELECT scenario_id, arg_max(case_id, (coalesce(score, -1), -case_id)) AS best_case,
       max(score) AS best_score, CAST(count(score) AS BIGINT) AS n_scored
FROM scored GROUP BY scenario_id""")
def scoring_best_case(spark, sf):
    """K4: the best case of each scenario (ties to the earlier case)."""
    return K.best_per_scenario(_sweep(spark, sf))


@register("scoring_ranked_cards", SWEEP_SQL + """
SELECT scenario_id, case_id, label, score, card_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY coalesce(score, -1) DESC, case_id)
                 AS BIGINT) AS card_rank
  FROM scored WHERE contains(lower(label), 'affordability')) WHERE card_rank <= 10""")
def scoring_ranked_cards(spark, sf):
    """T8 + F5: the first ten cards per scenario among 'affordability' cases."""
    cards = K.ranked_cards(_sweep(spark, sf), k=10, label_filter="Affordability")
    return cards.select("scenario_id", "case_id", "label", "score", "card_rank")


@register("scoring_all_cards", SWEEP_SQL + """
SELECT scenario_id, case_id, score, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY coalesce(score, -1) DESC, case_id)
       AS BIGINT) AS card_rank FROM scored""")
def scoring_all_cards(spark, sf):
    """The rank of every card of every scenario, by counting."""
    return K.ranked_cards(_sweep(spark, sf)).select("scenario_id", "case_id", "score", "card_rank")


@register("scoring_rank_stability", SWEEP_SQL + """,
b AS (SELECT case_id, coalesce(score, -1) AS x FROM scored WHERE scenario_id = 13),
h AS (SELECT scenario_id, x, coalesce(score, -1) AS y, count(*) AS n FROM scored JOIN b USING (case_id) GROUP BY ALL),
t AS (SELECT scenario_id, CAST(sum(n) AS BIGINT) AS n_cases FROM h GROUP BY scenario_id),
p AS (SELECT u.scenario_id, CAST(sum(CASE WHEN v.y > u.y THEN u.n * v.n ELSE 0 END) AS BIGINT) AS concordant,
             CAST(sum(CASE WHEN v.y < u.y THEN u.n * v.n ELSE 0 END) AS BIGINT) AS discordant
      FROM h u JOIN h v ON u.scenario_id = v.scenario_id AND v.x > u.x GROUP BY u.scenario_id)
SELECT scenario_id, n_cases, coalesce(concordant, 0) AS concordant, coalesce(discordant, 0) AS discordant,
  n_cases * (n_cases - 1) // 2 - coalesce(concordant, 0) - coalesce(discordant, 0) AS tied,
  CASE WHEN n_cases > 1 THEN coalesce(discordant, 0) / (n_cases * (n_cases - 1) // 2) END AS kendall
FROM t LEFT JOIN p USING (scenario_id)""")
def scoring_rank_stability(spark, sf):
    """K4: Kendall distance of every scenario's order to that of scenario 13."""
    return K.rank_stability(_sweep(spark, sf), base=13)


@register("scoring_factor_breakdown", SWEEP_SQL + """
SELECT scenario_id, case_id, factor_no, factor, rating, weight, rating * 20 AS width FROM (
  SELECT scenario_id, case_id, CAST(1 AS BIGINT) AS factor_no, 'Intervention potential' AS factor, r0 AS rating, CAST(w0 AS DOUBLE) AS weight FROM scored
  UNION ALL SELECT scenario_id, case_id, 2, 'Existing toolkit fit', r1, w1 FROM scored
  UNION ALL SELECT scenario_id, case_id, 3, 'Delivery capacity', r2, w2 FROM scored
  UNION ALL SELECT scenario_id, case_id, 4, 'Expansion feasibility', r3, w3 FROM scored
  UNION ALL SELECT scenario_id, case_id, 5, 'Evidence strength', r4, w4 FROM scored)""")
def scoring_factor_breakdown(spark, sf):
    """K5: factor rows (rating, weight, bar width) of every case under every
    scenario."""
    return K.factor_breakdown(_sweep(spark, sf)).select("scenario_id", "case_id", "factor_no", "factor", "rating",
                                        "weight", "width")


@register("scoring_report_json")
def scoring_report_json(spark, sf):
    """Nested JSON report lines (one per scenario and case)."""
    return K.report_json(_sweep(spark, sf))
