"""Quoted CSV over many files of any size (S1), with the order of records.

Fields may hold quoted line breaks, so a file cannot simply be cut at lines.
It is read as lines in parallel blocks; a line begins inside a quoted field
exactly when the quotes before it in its file are odd in number.  Each block
counts its quotes, and its record starts for either case; a running sum over
the blocks of a file (a few rows) says which case holds and how many records
came before.  Lines of one record are then joined (most records are one line
and pass untouched) and parsed.  Order is (file, record): files by path,
records by position, whatever block they were read in.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Records of one file in the order column, at most.
FILE_RECORDS = 1 << 40


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def _body(text: Column) -> Column:
    """A line or record without the carriage return before its line break."""
    return F.regexp_replace(text, r"\r\z", "")


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """_file, _record (0: the header), text of every record; blank lines between records count for nothing."""
    lines = _lines(spark, path).withColumn("_q", F.length("value") - F.length(F.translate("value", '"', "")))
    within = Window.partitionBy("_file", "_block").orderBy("_at")
    before = F.coalesce(F.sum("_q").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = lines.withColumn("_odd", (before % 2).cast("int")).withColumn("_full", _body(F.col("value")) != "")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    begins = {p: F.when((F.col("_odd") == p) & F.col("_full"), 1).otherwise(0) for p in (0, 1)}
    local = local.withColumns({f"_n{p}": F.sum(c).over(upto) for p, c in begins.items()})

    # What each block starts with: inside a field or not, and the records before it.
    blocks = local.groupBy("_file", "_block").agg(F.sum("_q").alias("q"), *[F.sum(c).alias(f"s{p}") for p, c in begins.items()])
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_inside", (F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).cast("int"))
    starts = F.when(F.col("_inside") == 0, F.col("s0")).otherwise(F.col("s1"))
    blocks = blocks.withColumn("_starts", starts).select(
        "_file", "_block", "_inside", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_records"))

    placed = local.join(blocks, ["_file", "_block"])
    open_ = F.col("_odd") != F.col("_inside")          # the line begins inside a quoted field
    record = F.col("_records") + F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1")) - 1
    placed = placed.withColumn("_record", record.cast("bigint")).where(open_ | F.col("_full"))
    alone = ~open_ & (F.col("_q") % 2 == 0)
    single = placed.where(alone).select("_file", "_record", F.col("value").alias("text"))
    several = placed.where(~alone).groupBy("_file", "_record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return single.unionByName(several).withColumn("text", _body(F.col("text")))


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Every column of the files' headers as a string, by name (a header that repeats a name
    means its last column; a file without a column has null), with ``_file``, ``_record``
    (from 0 in its file) and ``_seq``, which orders all records by file and position."""
    records = numbered_records(spark, path)
    byte_mark = F.regexp_replace("text", "^\ufeff", "")
    headers = records.where(F.col("_record") == 0).select("_file", byte_mark.alias("_header"))
    # A row for each file, as in the driver's own listing; one parse for every distinct header.
    heads = sorted((r["_file"], r["_header"]) for r in headers.collect())
    layouts = list(dict.fromkeys(h for _, h in heads))
    ranks = spark.createDataFrame([(f, i) for i, (f, _) in enumerate(heads)], "_file string, _rank bigint")
    body = records.where(F.col("_record") > 0)
    if len(layouts) > 1:
        body = body.join(headers, "_file")
    names = list(dict.fromkeys(n for h in layouts for n in _names(h)))
    parts = []
    for header in layouts:
        own = _names(header)
        rows = body.where(F.col("_header") == header) if len(layouts) > 1 else body
        schema = ", ".join(f"c{i} string" for i in range(len(own)))
        parsed = rows.withColumn("_p", F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true"}))
        last = {n: i for i, n in enumerate(own)}
        parts.append(parsed.select(
            *[(F.col(f"_p.c{last[n]}") if n in last else F.lit(None).cast("string")).alias(n) for n in names], "_file", "_record"))
    if not parts:
        return spark.createDataFrame([], "_file string, _record bigint, _seq bigint")
    every = reduce(DataFrame.unionByName, parts).withColumn("_record", F.col("_record") - 1)
    return every.join(ranks, "_file").select(*names, "_file", "_record", (F.col("_rank") * FILE_RECORDS + F.col("_record")).alias("_seq"))


def _names(header: str) -> list[str]:
    return next(csv.reader([header]), []) if "\n" not in header else next(csv.reader(header.split("\n")), [])
