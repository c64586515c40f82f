"""A feed of few indicators is not dealt by indicator (findings F1-F3 of round 3)."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tabulon.operators import ingest as I
from tests.conftest import SF_SMALL

FEED = "indicator_id string, SpatialDimType string, SpatialDim string, TimeDim string, Dim1 string, Dim3 string, NumericValue string"


@pytest.fixture()
def shuffle_joins(spark):
    """No broadcast, no merged partitions, as on tables of many GB."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_one_key_collapse_in_many_tasks(spark, shuffle_joins):
    feed = spark.range(4000).select(F.concat(F.lit("i"), (F.col("id") % 1).cast("string")).alias("indicator_id"),
                                    F.when(F.col("id") % 2 == 0, "T").otherwise("x").alias("d"))
    out = I.collapse_totals(feed, [("d", "T")])
    assert out.columns == feed.columns
    tasks = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()
    assert sum(r["n"] for r in tasks) == 2000 and {r["d"] for r in tasks} == {"T"}
    assert max(r["n"] for r in tasks) <= 1000


def test_feed_is_summed_before_it_is_collapsed(spark):
    rows = [("i", "COUNTRY", "AAA", "2000", "SEX_BTSX", None, "1")] * 3 + [("i", "COUNTRY", "AAA", "2000", "SEX_MLE", None, "9")]
    out = I.normalise_dim_feed(spark.createDataFrame(rows, FEED), None, mean_scale=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter"):]
    assert re.search(r"Aggregate \[indicator_id#\d+, SpatialDim#\d+, TimeDim#\d+, Dim1#\d+, Dim3#\d+\], .*_total", join)
    assert [(r["country_code"], r["year"], r["value"]) for r in out.collect()] == [("AAA", 2000, 1.0)]


@pytest.mark.parametrize("name", ["ingest_dim_feed", "ingest_json_records", "ingest_source_fallback"])
def test_queries_collapse_one_row_per_key(spark, monkeypatch, name):
    seen, collapse = [], I.collapse_totals
    monkeypatch.setattr(I, "collapse_totals", lambda feed, *a: seen.append(feed) or collapse(feed, *a))
    queries()[name](spark, SF_SMALL)
    keys = seen[0].select("indicator_id", "SpatialDim", "TimeDim", "Dim1", "Dim3")
    assert len(seen) == 1 and 0 < keys.count() == keys.distinct().count()


@pytest.mark.parametrize("scale", [4, None])
def test_sums_keep_every_rule_of_the_rows(spark, scale):
    total, part = "SEX_BTSX", "SEX_MLE"
    rows = [
        ("a", "COUNTRY", "AAA", "2000", total, None, "1"), ("a", "COUNTRY", "AAA", "2000.7", total, None, "4"),
        ("a", "COUNTRY", "AAA", "2000", total, None, "n/a"), ("a", "COUNTRY", "AAA", None, total, None, "7"),
        ("a", "COUNTRY", None, "2000", total, None, "7"), ("a", "COUNTRY", "AAA", "1e20", part, None, "1e37"),
        ("a", "REGION", "AAA", "2000", total, None, "50"),
        ("b", "COUNTRY", "BBB", "2001", part, None, "2"), ("b", "COUNTRY", "BBB", "2001", "SEX_FMLE", "Q1", "3"),
        ("c", "COUNTRY", "CCC", "2001", total, None, "n/a"), ("c", "COUNTRY", "CCC", "2001", part, None, "5"),
        (None, "COUNTRY", "DDD", "2002", total, "Q1", "6"), (None, "COUNTRY", "DDD", "2002", part, "Q2", "8"),
    ]
    names = spark.createDataFrame([("AAA", "Alpha"), ("AAA", "Alpha"), ("BBB", "Beta"), ("BBB", "Bet")], "Code string, Title string")
    out = I.normalise_dim_feed(spark.createDataFrame(rows, FEED), names, mean_scale=scale).collect()
    assert sorted((r["indicator_id"] or "", r["country_name"], r["year"], r["value"]) for r in out) == [
        ("", "DDD", 2002, 6.0), ("a", "Alpha", 2000, 2.5), ("b", "Bet", 2001, 2.0), ("b", "Beta", 2001, 2.0)]


def test_too_large_a_kept_value_still_fails_the_exact_mean(spark):
    rows = [("a", "COUNTRY", "AAA", "2000", None, None, "1e37")]
    with pytest.raises(Exception, match="too large|NUMERIC_VALUE_OUT_OF_RANGE"):
        I.normalise_dim_feed(spark.createDataFrame(rows, FEED), None, mean_scale=4).collect()


def _tables(spark, path, copies):
    """Every row of lineitem, orders and customer comes ``copies`` times, with its own order and customer keys."""
    row, day = F.col("id") % 200, F.expr("timestamp'1995-01-01' + make_dt_interval(CAST(id % 200 AS INT) * 9)")
    tables = {
        "nation": spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("n"), "id").alias("n_name")),
        "supplier": spark.range(10).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey")),
        "customer": spark.range(20 * copies).select(F.col("id").alias("c_custkey"), (F.col("id") % 20 % 3).cast("int").alias("c_nationkey")),
        "orders": spark.range(200 * copies).select(F.col("id").alias("o_orderkey"), (F.col("id") % (20 * copies)).alias("o_custkey"),
                                                   (row * 2.5).alias("o_totalprice"), day.alias("o_orderdate")),
        "lineitem": spark.range(200 * copies).select(
            F.col("id").alias("l_orderkey"), (row % 10).alias("l_suppkey"), (row % 7 + 1).cast("int").alias("l_linenumber"),
            (row % 50).cast("double").alias("l_quantity"), (row * 1.25).alias("l_extendedprice"), (row % 4 * 0.25).alias("l_discount"),
            F.expr("element_at(array('N', 'A', 'R'), CAST(id % 200 % 3 AS INT) + 1)").alias("l_returnflag"),
            F.expr("if(id % 200 % 2 = 0, 'O', 'F')").alias("l_linestatus"), day.alias("l_shipdate")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["ingest_json_records", "ingest_source_fallback"])
def test_no_more_rows_are_dealt_for_more_copies_of_the_feed(spark, monkeypatch, shuffle_joins, tmp_path, name):
    seen, collapse = [], I.collapse_totals
    monkeypatch.setattr(I, "collapse_totals", lambda feed, *a: seen.append(feed) or collapse(feed, *a))
    once, often = (queries()[name](spark, _tables(spark, tmp_path / str(n), n)) for n in (1, 10))
    few, more = (feed.count() for feed in seen)
    assert 0 < few == more < 600
    own = (F.get_json_object("json", "$.source") if once.columns == ["json"] else F.col("source")) == "WHO"
    assert len(rows := sorted(map(str, once.where(own).collect()))) > 0
    assert rows == sorted(map(str, often.where(own).collect()))
