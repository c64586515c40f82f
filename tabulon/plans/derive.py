"""Testdata analogues: inputs for the operators derived by Spark from the
given tables, so every query's work grows with the data.

Each builder has a DuckDB twin (a CTE string) used by the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.numeric import mean
from tabulon.sources.testdata import table

# Indicators of the order panel: id, label, category, unit, source,
# source_code, fallback_source, fallback_source_code.  avg_price names a
# different primary source, so provenance reports a fallback note for it.
ORDER_INDICATORS = [
    ("revenue", "Order Revenue", "Sales", "currency", "ORDERS", "o_totalprice", None, None),
    ("n_orders", "Order Count", "Sales", "orders", "ORDERS", "o_orderkey", None, None),
    ("avg_price", "Average Order Price", "Sales", "currency", "LINEITEM", "l_extendedprice", "ORDERS", "o_totalprice"),
]


def _long(agg: DataFrame, code, name, source: str) -> DataFrame:
    """Unpivot the three measures into panel rows."""
    return agg.select(
        code.alias("country_code"), name.alias("country_name"), F.col("year").cast("int").alias("year"),
        F.explode(F.array(
            F.struct(F.lit("revenue").alias("indicator_id"), F.round("revenue", 2).alias("value")),
            F.struct(F.lit("n_orders").alias("indicator_id"), F.col("n_orders").cast("double").alias("value")),
            F.struct(F.lit("avg_price").alias("indicator_id"), F.col("avg_price").alias("value")),
        )).alias("m"),
    ).select("country_code", "country_name", "year", "m.indicator_id", "m.value",
             F.lit(source).alias("source"))


def _measures(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("o_totalprice").alias("revenue"),
        F.count(F.lit(1)).alias("n_orders"),
        mean("o_totalprice", 2).alias("avg_price"),
    )


def nation_code(col) -> F.Column:
    """Three-character code 'N00'..'N24' for a nation key."""
    return F.concat(F.lit("N"), F.lpad(col.cast("string"), 2, "0"))


def nation_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel at (nation, order year) grain, indicators revenue, n_orders and
    avg_price.  orders joins customer on custkey (shuffle join, both sides
    large at scale); the aggregate is partial-before-shuffle, and the 25-row
    nation table is broadcast (TPC-H fixes its size)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey)
    agg = _measures(joined, "c_nationkey", "year")
    agg = agg.join(F.broadcast(nation), agg.c_nationkey == nation.n_nationkey)
    return _long(agg, nation_code(F.col("c_nationkey")), F.col("n_name"), "ORDERS")


def customer_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel at (customer, order year) grain: many customers skip years, so
    'previous row' and 'previous year' differ (W3)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    agg = _measures(orders, "o_custkey", "year")
    code = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return _long(agg, code, code, "ORDERS")


def nation_region_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region groups from the data: each TPC-H region, plus an overlapping
    'WORLD' group holding every nation (many-to-many).  Size is bounded by the
    nation table (25 rows in TPC-H)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    by_region = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                 .select(F.col("r_name").alias("region"), nation_code(F.col("n_nationkey")).alias("country_code")))
    world = nation.select(F.lit("WORLD").alias("region"), nation_code(F.col("n_nationkey")).alias("country_code"))
    return by_region.unionByName(world)


def order_registry(spark: SparkSession) -> DataFrame:
    from tabulon.sources.dims import registry_df
    return registry_df(spark, ORDER_INDICATORS)


# ----------------------------------------------------------- DuckDB twins

def _panel_sql(keys_select: str, group_keys: str, code: str, name: str, extra_join: str) -> str:
    return f"""
    SELECT {code} AS country_code, {name} AS country_name, CAST(a.year AS INTEGER) AS year,
           m.indicator_id, m.value, 'ORDERS' AS source
    FROM (
      SELECT {keys_select}, CAST(year(o_orderdate) AS INTEGER) AS year,
             round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders,
             CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) / CAST(count(o_totalprice) AS DOUBLE) AS avg_price
      FROM orders {extra_join}
      GROUP BY {group_keys}, year(o_orderdate)
    ) a {'JOIN nation n ON a.nk = n.n_nationkey' if 'nk' in keys_select else ''}
    CROSS JOIN LATERAL (VALUES ('revenue', a.revenue), ('n_orders', a.n_orders),
                               ('avg_price', a.avg_price)) AS m(indicator_id, value)
    """


NATION_PANEL_SQL = _panel_sql(
    "c.c_nationkey AS nk", "c.c_nationkey",
    "'N' || lpad(CAST(a.nk AS VARCHAR), 2, '0')", "n.n_name",
    "JOIN customer c ON o_custkey = c.c_custkey")

CUSTOMER_PANEL_SQL = _panel_sql(
    "o_custkey AS ck", "o_custkey",
    "'C' || CAST(a.ck AS VARCHAR)", "'C' || CAST(a.ck AS VARCHAR)", "")

BRIDGE_SQL = """
    SELECT r.r_name AS region, 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS country_code
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    UNION ALL
    SELECT 'WORLD' AS region, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code FROM nation
"""

ORDER_REGISTRY_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else "'" + v + "'" for v in row) + ")" for row in ORDER_INDICATORS
) + ") AS t(id, label, category, unit, source, source_code, fallback_source, fallback_source_code)"
