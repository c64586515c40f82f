"""Every registered query against its DuckDB twin on the same parquet tables
(the driver's correctness gate, run here on the smallest scale)."""

import os

import pytest

from tests.conftest import SF_SMALL

from tests.oracle_harness import compare, duck


def _registry():
    from __spark_entry__ import oracle_sql, queries
    from tabulon.plans import all_queries
    own = set(all_queries())  # the optional text operators have their own tests
    return ({k: v for k, v in queries().items() if k in own}, {k: v for k, v in oracle_sql().items() if k in own})


QUERIES, SQL = _registry()
SF = os.environ.get("TABULON_TEST_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF, name, QUERIES[name], SQL.get(name), con)
    assert res["status"] in ("ok", "no-sql"), res


def test_every_query_has_an_oracle_or_is_declared():
    no_sql = sorted(set(QUERIES) - set(SQL))
    # Only outputs that are not value-comparable to SQL (JSON report files).
    assert set(no_sql) <= {"ingest_json_records", "scoring_report_json"}, no_sql


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "admission_stream"))
def test_plan_has_no_pair_joins(spark, name):
    """No registered query plans a Cartesian product or a nested-loop join."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampType": "TIMESTAMP",
                 "TimestampNTZType": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(n for n in SQL if n != "admission_stream"))
def test_column_types_match_oracle(spark, con, name):
    schema = QUERIES[name](spark, SF).schema
    duck_types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 0").description}
    for f in schema.fields:
        t = type(f.dataType).__name__
        assert duck_types[f.name] == SPARK_TO_DUCK.get(t, t) or (
            t == "DecimalType" and duck_types[f.name].startswith("DECIMAL")), (name, f.name, t, duck_types[f.name])


def _single_partition_parents(plan: str):
    """Parent node of every single-partition exchange in a plan string."""
    import re
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        col = re.search(r"[A-Za-z]", line).start()
        parent = ""
        for j in range(i - 1, -1, -1):
            m = re.search(r"[A-Za-z]", lines[j])
            if m and m.start() < col:
                parent = lines[j]
                break
        out.append(parent)
    return out


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "admission_stream"))
def test_no_single_partition_window_or_sort(spark, name):
    """Single-partition exchanges only feed final global aggregates or limits
    (tiny partial results), never a window or a sort over whole data."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for parent in _single_partition_parents(plan):
        assert any(x in parent for x in ("Aggregate", "Limit", "TakeOrdered")), (name, parent.strip())
