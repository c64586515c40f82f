"""Panel queries (F1, F2, F6, F9, T2, W1-W4, A1-A6, J1, J2, J4) over the
order panels derived from orders x customer x nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import panel as P
from tabulon.plans.derive import (
    ORDER_INDICATORS,
    BRIDGE_SQL, CUSTOMER_PANEL_SQL, NATION_PANEL_SQL, ORDER_REGISTRY_SQL,
    customer_year_panel, nation_region_bridge, nation_year_panel, order_registry,
)
from tabulon.plans.registry import register
from tabulon.sources.testdata import table

NP = f"WITH panel AS ({NATION_PANEL_SQL})"
CP = f"WITH panel AS ({CUSTOMER_PANEL_SQL})"

FILTER_CODES = ["N01", "n03 ", "N05", "N07", "N11", "N13", "N17", "N19", "N23", "N05"]
FILTER_SQL_CODES = "('N01','N03','N05','N07','N11','N13','N17','N19','N23')"


@register("panel_rankings", NP + """
SELECT country_code, country_name, year, indicator_id, value, source, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator_id, year
                               ORDER BY value DESC NULLS LAST, country_code, source) AS rank
  FROM panel) WHERE rank <= 10""")
def panel_rankings(spark, sf):
    """Top 10 nations per (indicator, year), descending."""
    return P.rankings(nation_year_panel(spark, sf), top_n=10)


@register("panel_rank_range", NP + """
SELECT country_code, country_name, year, indicator_id, value, source, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator_id, year
                               ORDER BY value ASC NULLS LAST, country_code, source) AS rank
  FROM panel) WHERE rank BETWEEN 5 AND 15""")
def panel_rank_range(spark, sf):
    """Ranks 5..15 ascending, with the original rank numbers."""
    return P.rankings(nation_year_panel(spark, sf), ascending=True, rank_start=5, rank_end=15)


@register("panel_rank_year_filtered", NP + f"""
SELECT country_code, country_name, year, indicator_id, value, source, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator_id, year
                               ORDER BY value DESC NULLS LAST, country_code, source) AS rank
  FROM panel WHERE year = 1998 AND country_code IN {FILTER_SQL_CODES}) WHERE rank BETWEEN 2 AND 6""")
def panel_rank_year_filtered(spark, sf):
    """W1 + F6 + F1 pre-filter (the chat path filters countries before ranking)."""
    return P.rankings(nation_year_panel(spark, sf), year=1998, top_n=5, rank_start=2,
                      countries=FILTER_CODES)


@register("panel_filter", NP + f"""
SELECT * FROM panel WHERE country_code IN {FILTER_SQL_CODES} AND year >= 1996 AND year <= 1999""")
def panel_filter(spark, sf):
    """country list (upper-cased, trimmed, de-duplicated) and inclusive years."""
    return P.filter_panel(nation_year_panel(spark, sf), FILTER_CODES, 1996, 1999)


@register("panel_region_filter", NP + f", bridge AS ({BRIDGE_SQL})" + """
SELECT * FROM panel WHERE country_code IN (SELECT country_code FROM bridge WHERE region = 'ASIA')""")
def panel_region_filter(spark, sf):
    """member rows of one region group via a broadcast semi join."""
    return P.region_filter(nation_year_panel(spark, sf), nation_region_bridge(spark, sf), "ASIA")


@register("panel_year_over_year", CP + """
SELECT country_code, country_name, year, indicator_id, value, source,
       round(value - prev, 4) AS change,
       round(CASE WHEN prev <> 0 THEN (value / prev - 1) * 100 END, 4) AS pct_change
FROM (SELECT *, lag(value) OVER (PARTITION BY indicator_id, country_code ORDER BY year, source, value) AS prev
      FROM panel)""")
def panel_year_over_year(spark, sf):
    """W3/W4 at customer-year grain (gaps in years are bridged by 'previous row')."""
    out = P.year_over_year(customer_year_panel(spark, sf))
    return (out.withColumn("change", F.round("change", 4))
               .withColumn("pct_change", F.round("pct_change", 4)))


@register("panel_country_means", NP + """
SELECT indicator_id, country_code, country_name, round(avg(value), 4) AS value
FROM panel GROUP BY indicator_id, country_code, country_name""")
def panel_country_means(spark, sf):
    """A1."""
    return P.country_means(nation_year_panel(spark, sf)).withColumn("value", F.round("value", 4))


_CORR_ALL_YEARS = """
, a AS (SELECT country_code, country_name, avg(value) AS v FROM panel WHERE indicator_id = 'revenue'
        GROUP BY country_code, country_name),
  b AS (SELECT country_code, avg(value) AS v FROM panel WHERE indicator_id = 'avg_price'
        GROUP BY country_code, country_name),
  m AS (SELECT a.country_code, a.country_name, a.v AS x, b.v AS y FROM a JOIN b USING (country_code))
"""

_CORR_YEAR = """
, a AS (SELECT country_code, country_name, value AS v FROM panel WHERE indicator_id = 'revenue' AND year = 1997),
  b AS (SELECT country_code, value AS v FROM panel WHERE indicator_id = 'n_orders' AND year = 1997),
  m AS (SELECT a.country_code, a.country_name, a.v AS x, b.v AS y FROM a JOIN b USING (country_code))
"""

_CORR_SUMMARY = """
SELECT CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) >= 2 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0
            THEN round(corr(x, y), 4) END AS correlation
FROM m"""


@register("panel_correlation", NP + _CORR_ALL_YEARS + _CORR_SUMMARY)
def panel_correlation(spark, sf):
    """A2: Pearson r of country means (each side on its own years)."""
    summary, _ = P.correlate(nation_year_panel(spark, sf), "revenue", "avg_price")
    return summary


@register("panel_correlation_year", NP + _CORR_YEAR + _CORR_SUMMARY)
def panel_correlation_year(spark, sf):
    """A2 for one year."""
    summary, _ = P.correlate(nation_year_panel(spark, sf), "revenue", "n_orders", year=1997)
    return summary


@register("panel_correlation_points", NP + _CORR_ALL_YEARS + """
SELECT country_code, country_name, round(x, 4) AS x, round(y, 4) AS y
FROM m WHERE (SELECT count(*) FROM m) >= 2""")
def panel_correlation_points(spark, sf):
    """A3: scatter points (empty when fewer than two countries join)."""
    _, points = P.correlate(nation_year_panel(spark, sf), "revenue", "avg_price")
    return points.select("country_code", "country_name", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("panel_correlation_pairs", NP + """
, means AS (SELECT indicator_id, country_code, avg(value) AS v FROM panel GROUP BY indicator_id, country_code)
SELECT a.indicator_id AS indicator_a, b.indicator_id AS indicator_b, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) >= 2 AND stddev_samp(a.v) > 0 AND stddev_samp(b.v) > 0
            THEN round(corr(a.v, b.v), 4) END AS correlation
FROM means a JOIN means b ON a.country_code = b.country_code AND a.indicator_id < b.indicator_id
GROUP BY a.indicator_id, b.indicator_id""")
def panel_correlation_pairs(spark, sf):
    """A2 re-aimed to every indicator pair at once."""
    ids = [r[0] for r in ORDER_INDICATORS]
    return P.correlate_all_pairs(nation_year_panel(spark, sf), indicator_ids=ids)


@register("panel_summary", CP + """
SELECT indicator_id, CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(DISTINCT country_code) AS BIGINT) AS country_count,
       CAST(min(year) AS BIGINT) AS year_min, CAST(max(year) AS BIGINT) AS year_max,
       min(value) AS value_min, max(value) AS value_max
FROM panel GROUP BY indicator_id""")
def panel_summary(spark, sf):
    """A4 over the customer-grain panel."""
    return P.indicator_summary(customer_year_panel(spark, sf))


@register("panel_provenance", NP + f", reg AS ({ORDER_REGISTRY_SQL})" + """
, agg AS (SELECT indicator_id, list_sort(list_distinct(list(source))) AS srcs,
                 CAST(max(year) AS BIGINT) AS latest_year FROM panel GROUP BY indicator_id)
SELECT agg.indicator_id, array_to_string(srcs, ',') AS data_source, latest_year,
       CASE WHEN srcs[1] <> reg.source THEN 'Primary ' || reg.source ||
            ' data was unavailable; this result uses ' || srcs[1] || ' data.' END AS source_note
FROM agg LEFT JOIN reg ON agg.indicator_id = reg.id""")
def panel_provenance(spark, sf):
    """A5: sources used, latest year, fallback note."""
    return P.provenance(nation_year_panel(spark, sf), order_registry(spark))


@register("panel_scope_counts", NP + f"""
SELECT indicator_id, CAST(count(*) AS BIGINT) AS row_count, CAST(9 AS BIGINT) AS selected_country_count
FROM panel WHERE country_code IN {FILTER_SQL_CODES} GROUP BY indicator_id""")
def panel_scope_counts(spark, sf):
    """A6."""
    return P.scope_counts(nation_year_panel(spark, sf), FILTER_CODES)


@register("panel_registry_lookup", f"WITH reg AS ({ORDER_REGISTRY_SQL})" + """
, req AS (SELECT DISTINCT event_type AS indicator_id FROM events
          UNION SELECT id FROM reg)
SELECT req.indicator_id, reg.label, reg.unit, reg.source,
       CASE WHEN reg.label IS NULL THEN 'Unknown indicator id ''' || req.indicator_id || '''' END AS error
FROM req LEFT JOIN reg ON req.indicator_id = reg.id""")
def panel_registry_lookup(spark, sf):
    """Requested ids (event types plus the registry's own) looked up in
    the broadcast registry; unknown ids carry an error."""
    reg = order_registry(spark)
    req = (table(spark, sf, "events").select(F.col("event_type").alias("indicator_id"))
           .unionByName(reg.select(F.col("id").alias("indicator_id"))).distinct())
    return P.registry_lookup(req, reg)


@register("panel_region_rollup", NP + f", bridge AS ({BRIDGE_SQL})" + """
SELECT region, indicator_id, year, CAST(count(*) AS BIGINT) AS n_countries,
       round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM panel JOIN bridge USING (country_code) GROUP BY region, indicator_id, year""")
def panel_region_rollup(spark, sf):
    """Many-to-many bridge rollup."""
    out = P.region_rollup(nation_year_panel(spark, sf), nation_region_bridge(spark, sf))
    return out.withColumn("avg_value", F.round("avg_value", 4))


@register("panel_country_list", NP + "SELECT DISTINCT country_code, country_name FROM panel")
def panel_country_list(spark, sf):
    """T2."""
    return P.country_list(nation_year_panel(spark, sf))


@register("panel_records", CP + """
SELECT country_code, country_name, CAST(year AS INTEGER) AS year, CAST(value AS DOUBLE) AS value
FROM panel WHERE indicator_id = 'revenue' AND year >= 2000""")
def panel_records(spark, sf):
    """F9 projection of one indicator's recent rows."""
    panel = customer_year_panel(spark, sf).where(F.col("indicator_id") == "revenue")
    return P.record_projection(P.filter_panel(panel, None, 2000, None))


@register("panel_all_records", CP + """
SELECT country_code, country_name, CAST(year AS INTEGER) AS year, CAST(value AS DOUBLE) AS value FROM panel""")
def panel_all_records(spark, sf):
    """F9 projection of the whole panel."""
    return P.record_projection(customer_year_panel(spark, sf))


@register("panel_scope_asked", NP + f""",
asked AS (SELECT DISTINCT event_type AS indicator_id FROM events UNION SELECT 'revenue' UNION SELECT 'n_orders')
SELECT a.indicator_id, CAST(count(p.country_code) AS BIGINT) AS row_count, CAST(9 AS BIGINT) AS selected_country_count
FROM asked a LEFT JOIN (SELECT * FROM panel WHERE country_code IN {FILTER_SQL_CODES}) p USING (indicator_id) GROUP BY a.indicator_id""")
def panel_scope_asked(spark, sf):
    """A6 for the indicators asked for: those without rows (event types) count 0."""
    asked = table(spark, sf, "events").select(F.col("event_type").alias("indicator_id")).unionByName(
        order_registry(spark).where(F.col("id") != "avg_price").select(F.col("id").alias("indicator_id")))
    return P.scope_counts(nation_year_panel(spark, sf), FILTER_CODES, asked)
