"""Weighted scoring over scenario grids.

A case carries five base ratings, three resource requirements and whether
its plan is a supply plan.  A scenario is (budget, staff, horizon) tiers,
a priority and five weights.  Scoring is pure column arithmetic; sweeping
scenarios multiplies every case by a fixed, driver-side grid through
``explode`` of a literal array (a generator, not a join).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import js_round

# The five scoring factors, in order.
FACTORS = ["Intervention potential", "Existing toolkit fit", "Delivery capacity",
           "Expansion feasibility", "Evidence strength"]
PRIORITIES = ["balanced", "supply", "access"]


def capacity_rating(requirements: Column, tiers: Column) -> Column:
    """K2: clamp(4 + sum(sign(tier - need)) / 2, 1, 5), capped at 2 when any
    need exceeds its tier."""
    signs = F.zip_with(tiers, requirements, lambda s, n: F.signum(s - n))
    base = F.lit(4.0) + F.aggregate(signs, F.lit(0.0), lambda acc, x: acc + x) / F.lit(2.0)
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(5.0), base))
    unmet = F.exists(F.zip_with(tiers, requirements, lambda s, n: s < n), lambda b: b)
    return F.when(unmet, F.least(clamped, F.lit(2.0))).otherwise(clamped)


def feasibility_rating(base: Column, priority: Column, is_supply: Column) -> Column:
    """K3: clamp(base + {balanced 0, aligned +1, misaligned -1}, 1, 3)."""
    adj = (F.when(priority == "balanced", F.lit(0))
            .when((priority == "supply") == is_supply, F.lit(1)).otherwise(F.lit(-1)))
    return F.greatest(F.lit(1.0), F.least(F.lit(3.0), base.cast("double") + adj))


def scenario_ratings(ratings: Column, requirements: Column, tiers: Column,
                     priority: Column, is_supply: Column) -> Column:
    """Base ratings with factor 3 replaced by K2 and factor 4 by K3."""
    cap = capacity_rating(requirements, tiers)
    feas = feasibility_rating(F.element_at(ratings, 4), priority, is_supply)
    r = F.transform(ratings, lambda x: x.cast("double"))
    return F.array(F.element_at(r, 1), F.element_at(r, 2), cap, feas, F.element_at(r, 5))


def weighted_score(ratings: Column, weights: Column) -> Column:
    """K1: round(100 * sum(w * r / 5) / sum(w)), JavaScript rounding (half
    up); NULL when all weights are zero."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    s = F.aggregate(F.zip_with(ratings, weights, lambda v, w: v / F.lit(5.0) * w), F.lit(0.0),
                    lambda acc, x: acc + x)
    return F.when(total != 0, js_round(s / total * F.lit(100.0)).cast("bigint"))


def scenario_grid(weight_sets: list[list[float]], tiers=(1, 2, 3), priorities=PRIORITIES) -> list[tuple]:
    """Driver-side grid: (scenario_id, budget, staff, horizon, priority, weights)."""
    rows = []
    sid = 0
    for w in weight_sets:
        for b, s, h in itertools.product(tiers, repeat=3):
            for p in priorities:
                rows.append((sid, b, s, h, p, [float(x) for x in w]))
                sid += 1
    return rows


def sweep(cases: DataFrame, grid: list[tuple]) -> DataFrame:
    """K4: every case under every scenario, with ratings and score."""
    # The grid is a driver-side list of bounded size; it is written as ONE
    # SQL literal (a single parse in the JVM instead of thousands of column
    # objects) and exploded per case.
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    scen = F.expr("array(" + ", ".join(
        f"named_struct('scenario_id', CAST({sid} AS BIGINT), 'budget', {int(b)}, 'staff', {int(s)}, "
        f"'horizon', {int(h)}, 'priority', {q(p)}, 'weights', array("
        + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in w) + "))"
        for sid, b, s, h, p, w in grid) + ")")
    x = cases.withColumn("sc", F.explode(scen)).select("*", "sc.*").drop("sc")
    tiers = F.array(F.col("budget"), F.col("staff"), F.col("horizon"))
    x = x.withColumn("ratings_now", scenario_ratings(F.col("ratings"), F.col("requirements"), tiers,
                                                     F.col("priority"), F.col("is_supply")))
    return x.withColumn("score", weighted_score(F.col("ratings_now"), F.col("weights")))


# Ranges of the case order that the cards of one score are counted in.
ORDER_RANGES = 64
NO_SCORE = -1


def ranked_cards(scored: DataFrame, k: int | None = None, label_filter: str = "all",
                 by: str = "scenario_id", order_col: str = "case_id") -> DataFrame:
    """T8 + F5: optional case-insensitive label filter, then rank by score
    desc with NULL as -1 (last) and ties in case order, per scenario.  With
    ``k`` only the first k cards are kept (WindowGroupLimit pre-filters);
    without, see :func:`counting_ranks`."""
    df = scored
    if label_filter and label_filter != "all":
        df = df.where(F.contains(F.lower("label"), F.lit(label_filter.lower())))
    if k is None:
        return counting_ranks(df, by, order_col)
    w = Window.partitionBy(by).orderBy(F.coalesce(F.col("score"), F.lit(NO_SCORE)).desc(), F.col(order_col).asc())
    df = df.withColumn("card_rank", F.row_number().over(w)).where(F.col("card_rank") <= int(k))
    return df.withColumn("card_rank", F.col("card_rank").cast("bigint"))


def counting_ranks(scored: DataFrame, by: str = "scenario_id", order_col: str = "case_id") -> DataFrame:
    """T8 for all cards: ``card_rank`` by counting.

    A scenario has few different scores, so the cards before a score are a
    running sum over its histogram.  Cards of one score are counted in ranges
    of the case order (quantiles of ``order_col``, a bounded sketch), so the
    window that numbers cards holds those of one (scenario, score, range) and
    never a whole scenario, even if all its cards tie."""
    points = [i / ORDER_RANGES for i in range(1, ORDER_RANGES)]
    cuts = scored.agg(F.array_distinct(F.percentile_approx(order_col, points, 10_000))).first()[0] or []  # 63 numbers at most
    ranges = sum(((F.col(order_col) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = scored.withColumns({"_s": F.coalesce(F.col("score"), F.lit(NO_SCORE)), "_range": ranges})
    cells = placed.groupBy(F.col(by).alias("_by"), F.col("_s").alias("_cs"), F.col("_range").alias("_cr")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_by").orderBy(F.col("_cs").desc(), "_cr").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("_by", "_cs", "_cr", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(by, "_s", "_range").orderBy(order_col))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_s") == F.col("_cs")) & (F.col("_range") == F.col("_cr"))
    return placed.withColumn("_local", local).join(before, same).withColumn(
        "card_rank", (F.col("_before") + F.col("_local")).cast("bigint")).drop(
        "_s", "_range", "_by", "_cs", "_cr", "_before", "_local")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def rank_stability(scored: DataFrame, base: int = 0, by: str = "scenario_id", order_col: str = "case_id") -> DataFrame:
    """K4: how much each scenario keeps the order of a base scenario.

    Per scenario: ``n_cases`` in both (a missing score counts as -1, the
    last), ``concordant`` and ``discordant`` pairs of cases, ``tied`` pairs
    (equal in either) and ``kendall`` = discordant pairs / all pairs.  No pair
    of cases is formed: cases are counted by (base score, score), and pairs by
    sums over that table, at most one row for each two scores."""
    s = F.coalesce(F.col("score"), F.lit(NO_SCORE)).cast("bigint")
    mine = scored.select(F.col(by).alias("_by"), F.col(order_col).alias("_case"), s.alias("y"))
    other = scored.where(F.col(by) == base).select(F.col(order_col).alias("_case"), s.alias("x"))
    table = mine.join(other, "_case").groupBy("_by", "x", "y").agg(F.count("*").alias("n"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, i = np.unique(pdf["x"], return_inverse=True)
        ys, j = np.unique(pdf["y"], return_inverse=True)
        h = np.zeros((len(xs) + 1, len(ys) + 2), dtype=object)
        h[i, j + 1] = [int(v) for v in pdf["n"]]
        above = h[::-1].cumsum(axis=0)[::-1][1:]           # cases of a larger x, by y
        sums = above.cumsum(axis=1)
        cells = h[:-1]
        lower, upto = sums[:, :-2], sums[:, 1:-1]
        discordant = int((cells[:, 1:-1] * lower).sum())
        concordant = int((cells[:, 1:-1] * (sums[:, -1:] - upto)).sum())
        n = int(pdf["n"].sum())
        pairs = n * (n - 1) // 2
        return pd.DataFrame({"scenario_id": [pdf["_by"].iloc[0]], "n_cases": [n], "concordant": [concordant], "discordant": [discordant],
                             "tied": [pairs - concordant - discordant], "kendall": [discordant / pairs if pairs else None]})

    schema = f"scenario_id {_type(scored, by)}, n_cases bigint, concordant bigint, discordant bigint, tied bigint, kendall double"
    return table.groupBy("_by").applyInPandas(count, schema)


def best_per_scenario(scored: DataFrame) -> DataFrame:
    """Best case per scenario (ties to the earlier case) as an aggregate."""
    key = F.struct(F.coalesce(F.col("score"), F.lit(-1)).alias("s"), (-F.col("case_id")).alias("c"))
    return scored.groupBy("scenario_id").agg(
        F.max_by("case_id", key).alias("best_case"),
        F.max("score").alias("best_score"),
        F.count("score").cast("bigint").alias("n_scored"))


def factor_breakdown(scored: DataFrame) -> DataFrame:
    """K5: long form (factor, rating, weight, width = rating * 20)."""
    f = F.array(*[F.lit(x) for x in FACTORS])
    return scored.select(
        "scenario_id", "case_id",
        F.posexplode(F.arrays_zip(f.alias("factor"), F.col("ratings_now").alias("rating"),
                                  F.col("weights").alias("weight"))).alias("pos", "z")
    ).select("scenario_id", "case_id", (F.col("pos") + 1).cast("bigint").alias("factor_no"),
             F.col("z.factor").alias("factor"), F.col("z.rating").alias("rating"),
             F.col("z.weight").alias("weight"), (F.col("z.rating") * 20).alias("width"))


# ------------------------------------------------------------- peer tables

def parse_measure(col: Column) -> Column:
    """Leading number of a display measure ('698k ($107,799)' -> 698000,
    '$298,000 (2.76x)' -> 298000, '10% / 81% / 8%' -> 10); 'Not supplied'
    and other text -> NULL."""
    m = F.regexp_extract(col, r"^\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmM]?)", 1)
    unit = F.lower(F.regexp_extract(col, r"^\s*\$?[0-9][0-9,]*(?:\.[0-9]+)?\s*([kKmM]?)", 1))
    num = F.regexp_replace(m, ",", "").try_cast("double")
    mult = F.when(unit == "k", 1000.0).when(unit == "m", 1_000_000.0).otherwise(1.0)
    return F.when(m != "", num * mult)


def measure_shares(col: Column) -> Column:
    """N23 all numbers of a slashed measure ('10% / 81% / 8%' -> [10, 81, 8]);
    other text -> NULL."""
    part = r"[0-9]+(?:\.[0-9]+)?\s*%"
    shares = F.regexp_extract_all(col, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1))
    return F.when(F.rlike(col, F.lit(rf"^\s*{part}(?:\s*/\s*{part})+\s*$")),
                  F.transform(shares, lambda x: x.try_cast("double")))


def parenthetical_measure(col: Column) -> Column:
    """N23 second number: the value inside parentheses ('($107,799)' -> 107799,
    '(2.76x)' -> 2.76, '(15.7%)' -> 15.7)."""
    m = F.regexp_extract(col, r"\(\s*(?:FHA:\s*)?\$?([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.when(m != "", F.regexp_replace(m, ",", "").try_cast("double"))


def peer_table(peers: DataFrame) -> DataFrame:
    """K6: peers flagged focal (name = target) and reference (name = reference)."""
    return (peers.withColumn("is_focal", F.col("name") == F.col("target"))
                 .withColumn("is_reference", F.col("name") == F.col("reference")))


def target_reference_gaps(peers: DataFrame) -> DataFrame:
    """Per case, the focal and reference peers joined by *name*, their
    metrics side by side and the other-axis gap |focal - reference| to one
    decimal (access when the label mentions affordability, else
    affordability)."""
    focal = peers.where(F.col("name") == F.col("target")).select(
        "case_id", "label", F.col("affordability").alias("focal_affordability"),
        F.col("access").alias("focal_access"), F.col("units").alias("focal_units"))
    ref = peers.where(F.col("name") == F.col("reference")).select(
        "case_id", F.col("affordability").alias("ref_affordability"),
        F.col("access").alias("ref_access"), F.col("units").alias("ref_units"))
    j = focal.join(ref, "case_id")
    aff = F.contains(F.col("label"), F.lit("affordability"))
    other = F.when(aff, F.lit("access")).otherwise(F.lit("affordability"))
    gap = F.abs(F.when(aff, F.col("focal_access") - F.col("ref_access"))
                 .otherwise(F.col("focal_affordability") - F.col("ref_affordability")))
    return j.withColumn("other_axis", other).withColumn("other_axis_gap", F.round(gap, 1))


def distinct_communities(peers: DataFrame) -> DataFrame:
    """Peer rows and distinct community names."""
    return peers.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                     F.countDistinct("name").cast("bigint").alias("communities"))


def plan_sources(plans: DataFrame, sources: DataFrame) -> DataFrame:
    """Each plan's source keys in order, looked up in the source map
    (a small dimension)."""
    keys = plans.select("case_id", F.posexplode("sources").alias("source_pos", "key"))
    return keys.join(sources, "key", "left")


def report_json(scored: DataFrame) -> DataFrame:
    """Nested JSON report lines, one per (scenario, case): the weights
    map, the scenario, and the case's score and factor ratings.  One line per
    case keeps every record bounded however many cases a scenario has."""
    factor_map = F.map_from_arrays(F.array(*[F.lit(x) for x in FACTORS]), F.col("weights"))
    rating_map = F.map_from_arrays(F.array(*[F.lit(x) for x in FACTORS]), F.col("ratings_now"))
    return scored.select("scenario_id", "case_id", F.to_json(F.struct(
        factor_map.alias("weights"),
        F.struct("budget", "staff", "horizon", "priority").alias("scenario"),
        F.struct("case_id", "label", F.col("score").alias("matchScore"),
                 rating_map.alias("factorRatings")).alias("opportunity"))).alias("report"))
