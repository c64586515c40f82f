"""Nearest vectors over stored cells against all distances."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import vector_cells as V


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centers])
    return np.concatenate([x, x[:5], x[:1]])  # repeated vectors: ties


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    rows = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(data)] + [(-1, None, 0), (-2, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int")
    return V.build_cells(df, os.path.join(str(tmp_path_factory.mktemp("cells")), "i"), 20)


def plain(data, queries, k, first=1, keep=None):
    out = []
    for name, q in queries:
        d = ((data - q) ** 2).sum(axis=1)
        ids = [i for i in range(len(data)) if keep is None or keep(i)]
        best = sorted(ids, key=lambda i: (round(d[i], 6), i))[first - 1:first - 1 + k]
        out += [(name, i, round(d[i], 4), r) for r, i in enumerate(best, first)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.vec_id, round(r.distance, 4), r["rank"]) for r in df.collect())


def queries_of(spark, queries):
    return spark.createDataFrame([(n, [float(v) for v in q]) for n, q in queries], "query_id string, query_vec array<double>")


@pytest.mark.parametrize("k,first", [(1, 1), (10, 1), (10, 11), (70, 1), (2000, 1)])
def test_equal_to_all_distances(spark, data, index, k, first):
    rng = np.random.default_rng(5)
    queries = [(f"q{i}", data[i * 7] + rng.normal(size=8)) for i in range(20)] + [("far", np.full(8, 500.0))]
    got = rows_of(V.cell_topk(index, queries_of(spark, queries), k, rank_from=first))
    assert got == plain(data, queries, k, first)


def test_blocks_of_queries_and_filters(spark, data, index, monkeypatch):
    monkeypatch.setattr(V, "MAX_QUERY_BLOCK", 3)
    queries = [(f"q{i}", data[i * 11] + 0.1) for i in range(8)]
    assert rows_of(V.cell_topk(index, queries_of(spark, queries), 5)) == plain(data, queries, 5)
    got = rows_of(V.cell_topk(index, queries_of(spark, queries), 5, where=F.col("kind") == 1))
    assert got == plain(data, queries, 5, keep=lambda i: i % 3 == 1)


def test_far_cells_are_not_read(spark, data, index):
    cells = sorted(index.cells(spark).collect(), key=lambda r: r.cell)
    assert sum(c.n for c in cells) == len(data)
    pivots = np.array([c.pivot for c in cells])
    to_pivot = np.sqrt(((data[:40, None, :] - pivots[None]) ** 2).sum(axis=2))
    need = V.needed_cells(to_pivot, *(np.array([c[f] for c in cells], dtype=float) for f in ("n", "r_min", "r_max")), 10)
    assert need.any(axis=1).all() and need.mean() < 0.35
    plan = V.cell_topk(index, queries_of(spark, [("q", data[0])]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("cell#", "cell") or "PartitionFilters" in plan


def test_no_vectors_and_no_queries(spark, index, tmp_dir):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    empty = V.build_cells(none.unionByName(spark.createDataFrame([(1, None)], none.schema)), os.path.join(tmp_dir, "e"), 3)
    assert V.cell_topk(empty, queries_of(spark, [("q", np.zeros(8))]), 3).collect() == []
    assert V.cell_topk(index, queries_of(spark, [("q", np.zeros(8))]).limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        V.cell_topk(index, queries_of(spark, [("q", np.zeros(8))]), 0)
