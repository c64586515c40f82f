"""Ingest queries (N1-N10, S5, S12, S14, S15) over feeds derived from the
testdata: a dimensioned feed unpivoted from lineitem (return flag as the
sex-like breakdown, line status as the wealth-like one, nulls and
unparseable numbers injected by expression) and a daily entity feed from
orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import ingest as I
from tabulon.plans.derive import NATION_PANEL_SQL, nation_code, nation_year_panel
from tabulon.plans.registry import register
from tabulon.session import cut_lineage
from tabulon.sources.dims import registry_df
from tabulon.sources.files import json_records
from tabulon.sources.testdata import table

FEED_INDICATORS = ("quantity", "price", "discount")


def lineitem_dim_feed(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount")
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(sup, li.l_suppkey == sup.s_suppkey)
    sex = (F.when(F.col("l_returnflag") == "N", "SEX_BTSX")
            .when(F.col("l_returnflag") == "A", "SEX_MLE").otherwise("SEX_FMLE"))
    sex_no_total = F.when(F.col("l_returnflag") == "A", "SEX_MLE").otherwise("SEX_FMLE")
    wealth = (F.when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
               .when(F.col("l_linestatus") == "O", "WEALTHQUINTILE_TOTL").otherwise("WEALTHQUINTILE_Q1"))
    ms = F.explode(F.array(
        F.struct(F.lit("quantity").alias("indicator_id"), F.col("l_quantity").alias("v"), sex.alias("Dim1")),
        F.struct(F.lit("price").alias("indicator_id"), F.col("l_extendedprice").alias("v"), sex.alias("Dim1")),
        F.struct(F.lit("discount").alias("indicator_id"), F.col("l_discount").alias("v"),
                 sex_no_total.alias("Dim1")),
    )).alias("m")
    return j.select(
        F.when(F.col("l_linenumber") == 7, "REGION").otherwise("COUNTRY").alias("SpatialDimType"),
        nation_code(F.col("s_nationkey")).alias("SpatialDim"),
        F.year("l_shipdate").cast("string").alias("TimeDim"),
        wealth.alias("Dim3"), F.col("l_linenumber"), ms,
    ).select(
        "m.indicator_id", "SpatialDimType", "SpatialDim", "TimeDim", "m.Dim1", "Dim3",
        F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("m.v").cast("string"))
        .alias("NumericValue"),
    )


def nation_titles(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(nation_code(F.col("n_nationkey")).alias("Code"), F.col("n_name").alias("Title"))


def who_like_panel(spark, sf):
    return I.normalise_dim_feed(lineitem_dim_feed(spark, sf), nation_titles(spark, sf), "WHO", mean_scale=4)


DIM_FEED_SQL = """
feed AS (
  SELECT m.indicator_id,
         CASE WHEN l.l_linenumber = 7 THEN 'REGION' ELSE 'COUNTRY' END AS SpatialDimType,
         'N' || lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS SpatialDim,
         CAST(year(l.l_shipdate) AS VARCHAR) AS TimeDim,
         m.dim1 AS Dim1,
         CASE WHEN l.l_linenumber = 1 THEN NULL WHEN l.l_linestatus = 'O' THEN 'WEALTHQUINTILE_TOTL'
              ELSE 'WEALTHQUINTILE_Q1' END AS Dim3,
         CASE WHEN l.l_linenumber = 3 THEN NULL ELSE m.v END AS value
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  CROSS JOIN LATERAL (VALUES
    ('quantity', l.l_quantity, CASE l.l_returnflag WHEN 'N' THEN 'SEX_BTSX' WHEN 'A' THEN 'SEX_MLE' ELSE 'SEX_FMLE' END),
    ('price', l.l_extendedprice, CASE l.l_returnflag WHEN 'N' THEN 'SEX_BTSX' WHEN 'A' THEN 'SEX_MLE' ELSE 'SEX_FMLE' END),
    ('discount', l.l_discount, CASE l.l_returnflag WHEN 'A' THEN 'SEX_MLE' ELSE 'SEX_FMLE' END)
  ) AS m(indicator_id, v, dim1)
),
c AS (SELECT * FROM feed WHERE SpatialDimType = 'COUNTRY'),
f1 AS (SELECT indicator_id, max(CASE WHEN Dim1 IS NOT NULL THEN 1 ELSE 0 END) AS anyv,
              max(CASE WHEN Dim1 IS NULL OR Dim1 = 'SEX_BTSX' THEN 1 ELSE 0 END) AS tot
       FROM c GROUP BY indicator_id),
d1 AS (SELECT c.* FROM c JOIN f1 USING (indicator_id)
       WHERE NOT (anyv = 1 AND tot = 1) OR Dim1 IS NULL OR Dim1 = 'SEX_BTSX'),
f3 AS (SELECT indicator_id, max(CASE WHEN Dim3 IS NOT NULL THEN 1 ELSE 0 END) AS anyv,
              max(CASE WHEN Dim3 IS NULL OR Dim3 = 'WEALTHQUINTILE_TOTL' THEN 1 ELSE 0 END) AS tot
       FROM d1 GROUP BY indicator_id),
d3 AS (SELECT d1.* FROM d1 JOIN f3 USING (indicator_id)
       WHERE NOT (anyv = 1 AND tot = 1) OR Dim3 IS NULL OR Dim3 = 'WEALTHQUINTILE_TOTL'),
who AS (
  SELECT d3.SpatialDim AS country_code, coalesce(n.n_name, d3.SpatialDim) AS country_name,
         CAST(CAST(d3.TimeDim AS DOUBLE) AS INTEGER) AS year, d3.indicator_id,
         CAST(sum(CAST(d3.value AS DECIMAL(38,4))) AS DOUBLE) / CAST(count(d3.value) AS DOUBLE) AS value, 'WHO' AS source
  FROM d3 LEFT JOIN nation n ON d3.SpatialDim = 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0')
  WHERE d3.value IS NOT NULL AND d3.TimeDim IS NOT NULL
  GROUP BY 1, 2, 3, 4, 6
)"""


@register("ingest_dim_feed", "WITH " + DIM_FEED_SQL + """
SELECT country_code, country_name, year, indicator_id, value, source FROM who""")
def ingest_dim_feed(spark, sf):
    """Country rows, Dim1 then Dim3 total collapse (the discount series
    has no total and keeps every breakdown), name lookup, lenient numbers,
    drop incomplete, mean of duplicates."""
    return who_like_panel(spark, sf)


def orders_entity_feed(spark, sf):
    """Daily entity feed: one reading per order; market segment BUILDING rows
    carry an aggregate-style code that the ISO-3 filter must drop."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    code = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("OWID_WRL")).otherwise(nation_code(F.col("c_nationkey")))
    return j.select(
        F.col("n_name").alias("Entity"), code.alias("Code"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Day"),
        F.col("o_totalprice").cast("string").alias("latest_order_price"),
        F.col("o_orderkey").alias("_seq"),
    )


@register("ingest_daily_latest", """
WITH feed AS (
  SELECT n.n_name AS Entity,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'OWID_WRL' ELSE 'N' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') END AS Code,
         o.o_orderdate AS day, o.o_totalprice AS value, o.o_orderkey AS seq
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY Code, Entity, year(day) ORDER BY day DESC, seq DESC) AS rn
      FROM feed WHERE length(Code) = 3)
SELECT Code AS country_code, Entity AS country_name, CAST(year(day) AS INTEGER) AS year,
       'latest_order_price' AS indicator_id, value, 'OWID' AS source
FROM r WHERE rn = 1""")
def ingest_daily_latest(spark, sf):
    """N7, N9, N10 + S5 probing: ISO-3 filter, day -> year, latest reading per
    country-year (ties to the later input row)."""
    return I.normalise_entity_feed(orders_entity_feed(spark, sf), "latest_order_price", "OWID")


@register("ingest_snapshot_freshness", """
WITH latest AS (SELECT user_id AS key, max(ts) AS latest, CAST(count(*) AS BIGINT) AS n_snapshots
                FROM events GROUP BY user_id),
asof_t AS (SELECT max(ts) - INTERVAL 2 HOUR AS as_of FROM events)
SELECT key, n_snapshots,
       CAST(epoch_us(as_of) - epoch_us(latest) AS DOUBLE) / 1000000 AS age_seconds,
       (CAST(epoch_us(as_of) - epoch_us(latest) AS DOUBLE) / 1000000) < 3600 AS fresh
FROM latest CROSS JOIN asof_t""")
def ingest_snapshot_freshness(spark, sf):
    """Events as a snapshot log keyed by user; as-of = two hours before
    the newest event; fresh when younger than 3600 s (strict)."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"))
    as_of = ev.agg((F.max("fetched_at") - F.expr("INTERVAL 2 HOURS")).alias("as_of"))
    return I.fresh_snapshots(ev, as_of).select("key", "n_snapshots", "age_seconds", "fresh")


FALLBACK_REGISTRY = [
    (i, i, "Feed", "units", "WHO", i, "OWID", i) for i in ("quantity", "price", "discount", "revenue")
]


@register("ingest_source_fallback", "WITH " + DIM_FEED_SQL + f", owid AS ({NATION_PANEL_SQL})" + """
, raw AS (SELECT * FROM who UNION ALL
          SELECT country_code, country_name, year, indicator_id, value, 'OWID' AS source FROM owid),
reg AS (SELECT * FROM (VALUES ('quantity','WHO','OWID'), ('price','WHO','OWID'), ('discount','WHO','OWID'),
                              ('revenue','WHO','OWID')) AS t(id, source, fallback_source)),
ok AS (SELECT DISTINCT indicator_id, source FROM raw),
choice AS (
  SELECT reg.id AS indicator_id,
         CASE WHEN p.source IS NOT NULL THEN reg.source WHEN f.source IS NOT NULL THEN reg.fallback_source END AS source_used
  FROM reg LEFT JOIN ok p ON p.indicator_id = reg.id AND p.source = reg.source
           LEFT JOIN ok f ON f.indicator_id = reg.id AND f.source = reg.fallback_source)
SELECT raw.country_code, raw.country_name, raw.year, raw.indicator_id, raw.value, raw.source
FROM raw JOIN choice ON raw.indicator_id = choice.indicator_id AND raw.source = choice.source_used""")
def ingest_source_fallback(spark, sf):
    """Whole-series fallback.  A source 'loaded' an indicator when its
    feed produced rows for it; revenue has no primary rows, so its fallback
    series is used, while the others keep their primary."""
    who = who_like_panel(spark, sf)
    owid = nation_year_panel(spark, sf).withColumn("source", F.lit("OWID"))
    # the raw panel (aggregated, small next to its inputs) feeds both the
    # load statuses and the final filter: written once to the shared
    # checkpoint folder instead of recomputing lineitem twice
    raw = cut_lineage(who.unionByName(owid))
    status = raw.select("indicator_id", "source").distinct().withColumn("ok", F.lit(True))
    choice = I.choose_source(registry_df(spark, FALLBACK_REGISTRY), status)
    return I.apply_source_choice(raw, choice)


@register("ingest_json_records")
def ingest_json_records(spark, sf):
    """The normalised feed exported as JSON records, nulls kept."""
    return json_records(who_like_panel(spark, sf))
