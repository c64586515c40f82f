"""File scans (S1-S6) and sinks.

All scans declare their schema or read everything as strings, so nothing is
inferred by a pass over the data, and an empty input still has its schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
               order_col: str = "_seq") -> DataFrame:
    """Header CSV, UTF-8 with optional BOM, quoted fields with embedded
    commas and newlines, every column a string.

    ``order_col`` numbers records 0, 1, ... in file order within each file
    (``_file`` keeps the file path).  With ``multiLine`` a file is one scan
    partition, so ``monotonically_increasing_id`` taken right at the scan
    (before any shuffle) increases in record order; the dense number is a
    window partitioned by file, never a global one."""
    from pyspark.sql import Window

    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
              .option("mode", "PERMISSIVE"))
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    df = (df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_mono", F.monotonically_increasing_id()))
    w = Window.partitionBy("_file").orderBy("_mono")
    return df.withColumn(order_col, (F.row_number().over(w) - 1).cast("bigint")).drop("_mono")


def string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Wide all-string fact file; casts happen where values are used."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').schema(schema).csv(path))


DIM_FEED_ROW = T.StructType([
    T.StructField("SpatialDimType", T.StringType()),
    T.StructField("SpatialDim", T.StringType()),
    T.StructField("TimeDim", T.StringType()),
    T.StructField("Dim1", T.StringType()),
    T.StructField("Dim2", T.StringType()),
    T.StructField("Dim3", T.StringType()),
    T.StructField("NumericValue", T.StringType()),
])


def json_envelope(spark: SparkSession, path: str, row_schema: T.StructType = DIM_FEED_ROW,
                  indicator_id: str | None = None) -> DataFrame:
    """S3: ``{"value": [rows]}`` documents -> rows.  Missing keys become NULL
    columns; an empty array gives an empty frame with the declared schema.
    Numbers are read as strings so the lenient parse (N5) sees the raw text."""
    schema = T.StructType([T.StructField("value", T.ArrayType(row_schema))])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = df.select(F.explode("value").alias("r")).select("r.*")
    if indicator_id is not None:
        rows = rows.withColumn("indicator_id", F.lit(indicator_id))
    return rows


def code_title_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Code -> title dimension from a ``{"value":[{Code, Title}]}`` file."""
    row = T.StructType([T.StructField("Code", T.StringType()), T.StructField("Title", T.StringType())])
    return json_envelope(spark, path, row).select("Code", "Title").dropDuplicates(["Code"])


def entity_csv(spark: SparkSession, path: str, order_col: str = "_seq") -> DataFrame:
    """S5 input: an entity CSV read as strings with the header kept; the
    normaliser probes its columns (Year or Day, first value column)."""
    return quoted_csv(spark, path, None, order_col)


PEER_FIELDS = ("name", "form", "population", "affordability", "access", "value",
               "denial", "units", "rent", "fha")


def nested_cases(spark: SparkSession, path: str) -> DataFrame:
    """Nested case documents -> one row per (case, peer) with positions.
    Display measures stay strings here (parsed by the scoring operators)."""
    peer = T.StructType([T.StructField(f, T.StringType()) for f in PEER_FIELDS])
    case = T.StructType([
        T.StructField("label", T.StringType()), T.StructField("target", T.StringType()),
        T.StructField("reference", T.StringType()), T.StructField("peers", T.ArrayType(peer)),
    ])
    df = spark.read.schema(case).option("multiLine", True).json(path)
    with_id = df.withColumn("case_id", F.monotonically_increasing_id())
    return with_id.select("case_id", "label", "target", "reference",
                          F.posexplode("peers").alias("peer_pos", "peer")).select(
        "case_id", "label", "target", "reference", "peer_pos", "peer.*")


# ---------------------------------------------------------------------- sinks

def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, missing values as ``null`` (NaN and
    infinities are turned into NULL first; Spark would write them as strings)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_json_records(df: DataFrame, path: str, max_records_per_file: int = 1000) -> None:
    """S11 + S12: size-bounded files of JSON records."""
    (json_records(df).write.mode("overwrite")
        .option("maxRecordsPerFile", max_records_per_file).text(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                max_records_per_file: int | None = None) -> None:
    """Parquet sink with optional partition columns and a batch-size bound."""
    w = df.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
