"""tabulon: table operators for panel analytics, catalog ingestion, retrieval,
scoring, dialog validation and admission control, expressed as Spark
DataFrame plans.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst plans it and whole-stage codegen runs it.
Parameters are plain Python values validated on the driver before any job runs.
"""

from tabulon.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
