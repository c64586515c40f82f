"""Query plans over the testdata tables: each registered entry is a function
``(spark, sf_dir) -> DataFrame`` with an optional DuckDB twin."""

from tabulon.plans.registry import all_queries, all_oracle_sql

__all__ = ["all_queries", "all_oracle_sql"]
