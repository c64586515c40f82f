"""Hot-key-safe prefix scans over each key's time-ordered rows.

A window ``partitionBy(key).orderBy(ts)`` runs a key's whole timeline in one
task; a key holding a third of all rows becomes one third of the job in a
single task.  Here the timeline of a key with more than ``ROWS_PER_BUCKET``
rows is cut into value ranges of its timestamp: as many as its measured rows
ask for, at percentiles of a bounded sketch.  Smaller keys are one bucket and
enter no sketch.  Equal timestamps always share a bucket,
so ties never straddle a cut.  Per (key, bucket) the local prefix is a
window (parallel across buckets); each bucket's summary (max, count, last
time) over the *earlier* buckets of its key is a window over at most
``buckets`` rows per key; the two are joined on (key, bucket).  Exact for
associative prefixes: running max, running count, previous row's time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a key in one bucket (on average), and buckets of a key at most.
ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 1024


def with_buckets(df: DataFrame, key: str, t: str, buckets: int | None = None,
                 keep_cuts: bool = False) -> DataFrame:
    """Adds ``_bucket`` from per-key percentile cuts of the integer time column
    ``t``: bucket = number of cuts <= t, so bucket j (j >= 1) starts at the
    j-th distinct cut.  The number of buckets follows the key's rows (a sketch
    is built for keys of several buckets only); ``buckets`` sets it for all
    keys.  The cut table has one row per key of several buckets; joining it is
    an equi-join on the key (AQE splits a skewed key's partitions).
    ``keep_cuts`` keeps the sorted distinct cuts as ``_cuts``."""
    none = F.array().cast("array<bigint>")
    if buckets is not None and buckets <= 1:
        df = df.withColumn("_bucket", F.lit(0))
        return df.withColumn("_cuts", none) if keep_cuts else df
    n = F.count(F.col(t))
    wanted = F.lit(buckets) if buckets else F.least(F.ceil(n / ROWS_PER_BUCKET), F.lit(MAX_BUCKETS))
    large = df.groupBy(F.col(key).alias("_ck")).agg(wanted.cast("int").alias("_want")).where(F.col("_want") > 1)
    grid = buckets or MAX_BUCKETS
    sketch = F.percentile_approx(F.col(t), [i / grid for i in range(1, grid)], max(1000, 4 * grid))
    cuts = (df.select(F.col(key).alias("_k2"), t).join(large, F.col("_k2").eqNullSafe(F.col("_ck")))
              .groupBy("_ck", "_want").agg(sketch.alias("_all"))
              .select("_ck", F.array_sort(F.array_distinct(F.transform(
                  F.sequence(F.lit(1), F.col("_want") - 1),
                  lambda i: F.get("_all", F.ceil(i * grid / F.col("_want")).cast("int") - 1)))).alias("_cuts")))
    joined = df.join(cuts, F.col(key).eqNullSafe(F.col("_ck")), "left").drop("_ck") \
        .withColumn("_cuts", F.coalesce(F.filter("_cuts", lambda c: c.isNotNull()), none))
    out = joined.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col(t))))
    return out if keep_cuts else out.drop("_cuts")


def _carry(bucketed: DataFrame, key: str, aggs: list[Column], names: list[str], combine: dict) -> DataFrame:
    """Per (key, bucket): the combined summaries of all earlier buckets
    (key renamed ``_ck`` / ``_cb`` for a null-safe join back)."""
    per = bucketed.groupBy(F.col(key).alias("_ck"), F.col("_bucket").alias("_cb")).agg(*aggs)
    w = Window.partitionBy("_ck").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_ck", "_cb", *[combine[n](F.col(n)).over(w).alias(f"_carry_{n}") for n in names])


def _join_carry(df: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    cond = F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_bucket") == F.col("_cb"))
    return df.join(carry, cond).drop("_ck", "_cb")


def running_max(df: DataFrame, key: str, order: list[str], t: str, value: str, out: str,
                buckets: int | None = None) -> DataFrame:
    """``max(value) over (partition by key order by order rows unbounded
    preceding)`` computed per time bucket plus a carry from earlier buckets."""
    b = with_buckets(df, key, t, buckets)
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_local", F.max(value).over(w))
    carry = _carry(b, key, [F.max(value).alias("m")], ["m"], {"m": F.max})
    return (_join_carry(local, carry, key)
                 .withColumn(out, F.greatest(F.col("_local"), F.col("_carry_m")))
                 .drop("_local", "_carry_m", "_bucket"))


def gap_segments(df: DataFrame, key: str, order: list[str], t: str, gap: int, out: str = "_seg",
                 buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """Segment number per row: the count of rows so far (in ``order``) whose
    time exceeds the previous row's time by more than ``gap``.  The previous
    row of a bucket's first row is the last row of the earlier buckets.
    ``keep_bucket`` keeps the bucket of each row as ``_bucket``."""
    b = with_buckets(df, key, t, buckets)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    carry = _carry(b, key, [F.max(t).alias("last")], ["last"], {"last": F.max})
    first_pass = (_join_carry(b, carry, key)
                   .withColumn("_prev", F.coalesce(F.lag(t).over(w), F.col("_carry_last")))
                   .withColumn("_new", F.when(F.col(t) - F.col("_prev") > gap, 1).otherwise(0)))
    local = first_pass.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = _carry(first_pass, key, [F.sum("_new").alias("n")], ["n"], {"n": F.sum})
    return (_join_carry(local, starts, key)
                 .withColumn(out, F.col("_local") + F.coalesce(F.col("_carry_n"), F.lit(0)))
                 .drop("_prev", "_new", "_local", "_carry_last", "_carry_n", *([] if keep_bucket else ["_bucket"])))


def range_count(df: DataFrame, key: str, t: str, width: int, out: str,
                buckets: int | None = None) -> DataFrame:
    """``count(*) over (partition by key order by t range between width
    preceding and current row)`` per (key, bucket) with a halo: every row is
    also copied (as a non-output row) into each later bucket of its key that
    starts no later than ``t + width``, which is exactly the set of buckets
    whose rows can have it inside their window.  The halo of a bucket is the
    rows within one window before its start, so the work per task stays
    proportional to the window density, not to the key's size."""
    b = with_buckets(df, key, t, buckets, keep_cuts=True)
    far = F.size(F.filter("_cuts", lambda c: c <= F.col(t) + F.lit(width)))
    halo = F.when(far > F.col("_bucket"), F.sequence(F.col("_bucket") + 1, far)).otherwise(
        F.array().cast("array<int>"))
    copies = F.concat(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("real"))),
                      F.transform(halo, lambda j: F.struct(j.alias("b"), F.lit(False).alias("real"))))
    rows = b.withColumn("_copy", F.explode(copies)).drop("_cuts")
    rows = rows.withColumn("_bucket", F.col("_copy.b")).withColumn("_real", F.col("_copy.real")).drop("_copy")
    w = Window.partitionBy(key, "_bucket").orderBy(F.col(t)).rangeBetween(-width, 0)
    return (rows.withColumn(out, F.count(F.lit(1)).over(w))
                .where(F.col("_real")).drop("_real", "_bucket"))
