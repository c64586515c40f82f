"""Session construction and cluster-facing settings.

Library code never creates its own session; callers (tests, bench, the entry
module) do.  ``checkpoint_dir`` reads the shared folder the cluster names in
``spark.checkpoint.dir`` and only falls back to a scratch folder when the
setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job here relies on: UTC for timestamp -> year,
# AQE for runtime coalescing / skew splitting / join re-planning.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tabulon", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_defaults(spark)
    checkpoint_dir(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings; safe to call on a session someone else built."""
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    make_package_importable(spark)


def make_package_importable(spark: SparkSession) -> None:
    """Python workers unpickle the Arrow-batch functions by module reference,
    so they must import this package.  In local mode the package root is
    added to the workers' PYTHONPATH (the context environment travels with
    every Python function created afterwards).  On a cluster the package is
    shipped the usual way (``--py-files`` or an installed wheel)."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root] + paths)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Uses the cluster's ``spark.checkpoint.dir``
    (or one already set on the context).  Only a local-mode session (tests)
    without the setting gets a scratch folder; on a cluster a machine-local
    folder would not survive executor loss, so the setting is required."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
        configured = tempfile.mkdtemp(prefix="tabulon-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss,
    unlike ``localCheckpoint``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    return int(os.environ.get("TABULON_PARALLELISM", spark.sparkContext.defaultParallelism))
