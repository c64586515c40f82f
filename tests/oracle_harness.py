"""Run every registered query on Spark and its oracle SQL on DuckDB, then
compare row count, column names and order-insensitive values.

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tabulon.sources.testdata import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, name, fn, sql, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    if sql is None:
        return {"name": name, "status": "no-sql", "rows": len(s_rows), "sec": round(t_spark, 2)}
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t_spark, 2)}
    if sorted(s_cols) != sorted(d_cols):
        res.update(status="COLUMNS", spark_cols=s_cols, oracle_cols=d_cols)
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if len(a) != len(b):
        res.update(status="ROWCOUNT")
        return res
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res.update(status="VALUES", sample=diffs, cols=sorted(s_cols))
        return res
    res.update(status="ok")
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tabulon.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            res = compare(spark, sf_dir, name, fn, sqls.get(name), con)
        except Exception as e:  # noqa: BLE001
            res = {"name": name, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if res["status"] not in ("ok", "no-sql"):
            bad += 1
        print(res, flush=True)
    print(f"{len(qs)} queries, {bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
