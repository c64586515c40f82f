"""Correlations of many indicators against pandas; scope counts with zeros."""

import random

import pandas as pd
import pytest

from tabulon.operators import panel as P


def panel_of(spark, n_indicators, n_countries, seed):
    rng = random.Random(seed)
    rows = [(f"C{c:03d}", f"Country {c}", 2000 + y, f"i{i:04d}", 3.0 if i == 2 else rng.gauss(i * 1e4, 1 + i % 3), "s")
            for i in range(n_indicators) for c in range(n_countries) if rng.random() < 0.7 for y in range(2)]
    rows += [("X1", "x", 2000, "lonely", 5.0, "s"), (None, "y", 2000, "i0000", 1.0, "s"), ("C000", "z", 2000, "i0001", None, "s")]
    return spark.createDataFrame(rows, P.PANEL_SCHEMA), rows


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_all_pairs_equal_pandas(spark, monkeypatch, tile):
    monkeypatch.setattr(P, "TILE_ROWS", 50)
    panel, rows = panel_of(spark, 16, 25, 3)
    got = {(r.indicator_a, r.indicator_b): (r.n, r.correlation) for r in P.correlate_all_pairs(panel, tile=tile).collect()}
    wide = pd.DataFrame(rows, columns=list(P.PANEL_COLUMNS[:3]) + ["indicator_id", "value", "source"]).fillna({"country_code": ""}) \
        .groupby(["country_code", "indicator_id"])["value"].mean().unstack()
    ids = sorted(wide.columns)
    assert len(got) == len(ids) * (len(ids) - 1) // 2
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = wide[[a, b]].dropna()
            r = both[a].corr(both[b]) if len(both) > 1 and both[a].nunique() > 1 and both[b].nunique() > 1 else None
            n, c = got[a, b]
            assert n == len(both) and (c is None if r is None else c == pytest.approx(r, abs=6e-5)), (a, b)


def test_two_thousand_indicators_without_an_expression_a_pair(spark):
    rng = random.Random(1)
    rows = [(f"C{c}", "c", 2000, f"i{i:04d}", rng.random(), "s") for i in range(2000) for c in range(6)]
    out = P.correlate_all_pairs(spark.createDataFrame(rows, P.PANEL_SCHEMA), indicator_ids=[f"i{i:04d}" for i in range(2000)])
    assert out.count() == 2000 * 1999 // 2
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_few_indicators(spark):
    panel, _ = panel_of(spark, 1, 3, 1)
    assert P.correlate_all_pairs(panel.where("indicator_id = 'lonely'")).collect() == []


def test_scope_counts_indicators_without_rows(spark):
    panel, _ = panel_of(spark, 2, 5, 2)
    out = P.scope_counts(panel, ["C001"], ["i0000", "none", "lonely"]).collect()
    got = {r.indicator_id: r.row_count for r in out}
    assert got["none"] == 0 == got["lonely"] and set(got) == {"i0000", "none", "lonely"}
    assert {r.selected_country_count for r in out} == {1}
