"""A chat context looks at the rows that requests select (finding F4 of round 3)."""

from pyspark.sql import functions as F

from tabulon.operators import context as C


def test_chat_context_reads_the_values_of_the_panel_once_a_kind_of_request(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        read.add(1)
        return float(i)

    n = 400
    panel = spark.range(n).select(
        F.lit("i").alias("indicator_id"), F.concat(F.lit("C"), (F.col("id") % 100).cast("string")).alias("country_code"),
        F.lit("name").alias("country_name"), (2000 + F.col("id") / 100).cast("int").alias("year"), value("id").alias("value"))
    requests = spark.createDataFrame(
        [(1, "rankings", ["i"], ["c1", "c2"], 2001, 1, 5, "asc"), (2, "trend", ["i"], [], 2002, None, None, None),
         (3, "correlation", ["i", "i"], ["C3", "c4"], None, None, None, None), (4, "trend", ["i"], ["c5"], 2000, None, None, None)],
        "request_id int, mode string, indicators array<string>, countries array<string>, year int, rank_start int, rank_end int, order_dir string")
    registry = spark.createDataFrame([("i", "I", "u", "S")], "id string, label string, unit string, source string")
    out = {r["request_id"]: r for r in C.chat_context(requests, panel, registry, max_rows=50).collect()}
    assert {k: r["decision"] for k, r in out.items()} == {1: "raw", 2: "reject_rows", 3: "raw", 4: "raw"}
    assert out[4]["context"].count('"value":') == 4 and out[2]["context"] is None
    assert 0 < read.value <= 2 * n
