"""Peer-comparison queries (S6, N23, K6, J6, J7, A7) over nested cases
derived from the testdata: one case per region, its peers the region's
nations (TPC-H fixes five per region, so each nested list is bounded by the
nation table), with display measures printed the way the reference's data
file shows them ('698k ($107,799)', '$298,000 (2x)', 'Not supplied') and
parsed back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import scoring as K
from tabulon.plans.derive import nation_code
from tabulon.plans.registry import register
from tabulon.sources.testdata import table


def _nation_stats(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_cust"), F.avg("c_acctbal").alias("avg_bal"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_sup"))
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rev = o.join(cust, o.o_custkey == cust.c_custkey).groupBy("c_nationkey").agg(
        F.round(F.sum("o_totalprice")).cast("bigint").alias("revenue"))
    n = table(spark, sf, "nation")
    return (n.join(c, n.n_nationkey == c.c_nationkey, "left")
             .join(s, n.n_nationkey == s.s_nationkey, "left")
             .join(rev.withColumnRenamed("c_nationkey", "rk"), n.n_nationkey == F.col("rk"), "left")
             .select("n_nationkey", "n_name", "n_regionkey",
                     F.coalesce("n_cust", F.lit(0)).alias("n_cust"), F.coalesce("n_sup", F.lit(0)).alias("n_sup"),
                     F.coalesce("revenue", F.lit(0)).alias("revenue"), "avg_bal"))


def nested_cases(spark, sf):
    """Cases with their peers nested (array of structs, as a nested scan
    would produce), then posexploded exactly like ``sources.files.nested_cases``."""
    st = _nation_stats(spark, sf)
    peer = F.struct(
        F.col("n_nationkey").alias("k"),
        F.col("n_name").alias("name"), F.lit("nation").alias("form"),
        F.concat(F.col("n_cust").cast("string"), F.lit("k ($"), F.format_number(F.col("revenue"), 0),
                 F.lit(")")).alias("population"),
        F.round(F.col("avg_bal") / 100, 1).alias("affordability"),
        F.round(F.col("n_sup") * 100.0 / F.greatest(F.col("n_cust"), F.lit(1)), 1).alias("access"),
        F.when(F.col("n_sup") > 0, F.concat(
            F.lit("$"), F.format_number(F.floor(F.col("revenue") / F.greatest(F.col("n_cust"), F.lit(1))), 0),
            F.lit(" ("), F.col("n_sup").cast("string"), F.lit("x)")))
         .otherwise(F.lit("Not supplied")).alias("value"),
        F.col("n_cust").cast("double").alias("units"))
    r = table(spark, sf, "region")
    cases = (st.groupBy("n_regionkey").agg(
                F.array_sort(F.collect_list(peer)).alias("peers"),
                F.max_by("n_name", "n_nationkey").alias("target"),
                F.min_by("n_name", "n_nationkey").alias("reference"))
               .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
               .select(F.col("r_regionkey").cast("bigint").alias("case_id"),
                       F.concat(F.lower("r_name"), F.when(F.col("r_regionkey") % 2 == 0, F.lit(" affordability"))
                                .otherwise(F.lit(" access"))).alias("label"),
                       "target", "reference", "peers"))
    return cases.select("case_id", "label", "target", "reference",
                        F.posexplode("peers").alias("peer_pos", "peer")).select(
        "case_id", "label", "target", "reference", F.col("peer_pos").cast("bigint").alias("peer_pos"), "peer.*")


PEERS_SQL = """
WITH cs AS (SELECT c_nationkey, count(*) AS n_cust, avg(c_acctbal) AS avg_bal FROM customer GROUP BY c_nationkey),
ss AS (SELECT s_nationkey, count(*) AS n_sup FROM supplier GROUP BY s_nationkey),
rv AS (SELECT c_nationkey, CAST(round(sum(o_totalprice)) AS BIGINT) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
st AS (SELECT n_nationkey, n_name, n_regionkey, coalesce(n_cust, 0) AS n_cust, coalesce(n_sup, 0) AS n_sup,
              coalesce(revenue, 0) AS revenue, avg_bal
       FROM nation LEFT JOIN cs ON n_nationkey = cs.c_nationkey LEFT JOIN ss ON n_nationkey = s_nationkey
       LEFT JOIN rv ON n_nationkey = rv.c_nationkey),
peers AS (
  SELECT CAST(n_regionkey AS BIGINT) AS case_id,
         lower(r_name) || CASE WHEN r_regionkey % 2 = 0 THEN ' affordability' ELSE ' access' END AS label,
         max_by(n_name, n_nationkey) OVER (PARTITION BY n_regionkey) AS target,
         min_by(n_name, n_nationkey) OVER (PARTITION BY n_regionkey) AS reference,
         CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS peer_pos,
         n_name AS name, 'nation' AS form,
         CAST(n_cust AS VARCHAR) || 'k ($' || format('{:,}', revenue) || ')' AS population,
         round(avg_bal / 100, 1) AS affordability,
         round(n_sup * 100.0 / greatest(n_cust, 1), 1) AS access,
         CASE WHEN n_sup > 0 THEN '$' || format('{:,}', CAST(floor(revenue / greatest(n_cust, 1)) AS BIGINT))
              || ' (' || CAST(n_sup AS VARCHAR) || 'x)' ELSE 'Not supplied' END AS value,
         CAST(n_cust AS DOUBLE) AS units
  FROM st JOIN region ON n_regionkey = r_regionkey)"""


@register("housing_peer_table", PEERS_SQL + """
SELECT case_id, peer_pos, name, name = target AS is_focal, name = reference AS is_reference,
       CAST(CAST(split_part(population, 'k', 1) AS BIGINT) * 1000 AS DOUBLE) AS population_num,
       CAST(replace(regexp_extract(population, '\\(\\s*\\$?([0-9][0-9,]*)', 1), ',', '') AS DOUBLE) AS population_paren,
       CASE WHEN value = 'Not supplied' THEN NULL
            ELSE CAST(replace(regexp_extract(value, '^\\$([0-9][0-9,]*)', 1), ',', '') AS DOUBLE) END AS value_num
FROM peers""")
def housing_peer_table(spark, sf):
    """S6 + K6 + N23: peer rows flagged focal/reference, display measures
    parsed to numbers ('k' suffix x1000, parenthetical amounts, 'Not
    supplied' -> NULL)."""
    p = K.peer_table(nested_cases(spark, sf))
    return p.select("case_id", "peer_pos", "name", "is_focal", "is_reference",
                    K.parse_measure(F.col("population")).alias("population_num"),
                    K.parenthetical_measure(F.col("population")).alias("population_paren"),
                    K.parse_measure(F.col("value")).alias("value_num"))


@register("housing_target_gaps", PEERS_SQL + """
SELECT f.case_id, f.label, f.affordability AS focal_affordability, f.access AS focal_access,
       r.affordability AS ref_affordability, r.access AS ref_access,
       CASE WHEN contains(f.label, 'affordability') THEN 'access' ELSE 'affordability' END AS other_axis,
       round(CASE WHEN contains(f.label, 'affordability') THEN abs(f.access - r.access)
                  ELSE abs(f.affordability - r.affordability) END, 1) AS other_axis_gap
FROM (SELECT * FROM peers WHERE name = target) f JOIN (SELECT * FROM peers WHERE name = reference) r
  USING (case_id)""")
def housing_target_gaps(spark, sf):
    """Focal and reference peers joined by name, other-axis gap."""
    g = K.target_reference_gaps(nested_cases(spark, sf))
    return g.select("case_id", "label", "focal_affordability", "focal_access", "ref_affordability", "ref_access",
                    "other_axis", "other_axis_gap")


@register("housing_communities", PEERS_SQL + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT name) AS BIGINT) AS communities FROM peers""")
def housing_communities(spark, sf):
    """Peer rows and distinct community names."""
    return K.distinct_communities(nested_cases(spark, sf))


@register("housing_plan_sources", """
WITH plans AS (SELECT CAST(n_regionkey AS BIGINT) AS case_id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS key,
                      CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS INTEGER)
                        AS source_pos FROM nation)
SELECT p.case_id, p.source_pos, p.key, n.n_name AS source_name
FROM plans p LEFT JOIN nation n ON p.key = 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0')""")
def housing_plan_sources(spark, sf):
    """Each case's plan cites its peers' codes (newest key first); the
    keys are looked up in order in the source map (the nation dimension)."""
    n = table(spark, sf, "nation")
    plans = n.groupBy(F.col("n_regionkey").cast("bigint").alias("case_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.col("n_nationkey")), asc=False),
                    lambda k: nation_code(k)).alias("sources"))
    sources = n.select(nation_code(F.col("n_nationkey")).alias("key"), F.col("n_name").alias("source_name"))
    return K.plan_sources(plans, sources).select("case_id", F.col("source_pos").cast("int").alias("source_pos"),
                                                 "key", "source_name")
