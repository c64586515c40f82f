"""Chat payloads, value by value."""

import json

import pytest

from tabulon.operators.payload import payload_check

GOOD = {"message": " hi ", "mode": "trend", "indicators": [{"id": "a", "label": "A", "unit": None, "other": 5}],
        "filters": {"countries": ["usa", "DE_1"], "year": 2000, "top_n": None, "order": "asc"},
        "snapshot": {"rows": [{"country_code": "USA", "value": 1.5, "junk": True}], "points": [{"x": 1, "y": -2.5}],
                     "statistics": [{"label": "mean", "value": "n/a"}, {"label": "n", "value": 3}]},
        "history": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return out


ROW = {"value": 1}
CASES = [
    (GOOD, None), ({k: v for k, v in GOOD.items() if k in ("message", "mode", "indicators")}, None),
    ([1], "payload"), ("x", "payload"), (changed(["message"], "  "), "message"), (changed(["message"], 5), "message"),
    (changed(["message"], "m" * 1001), "message"), (changed(["mode"], "map"), "mode"), (changed(["mode"], None), "mode"),
    (changed(["indicators"], {"id": "a"}), "indicators"), (changed(["indicators", 0], "a"), "indicators"),
    (changed(["indicators", 0, "id"], "zz"), "indicators"), (changed(["indicators", 0, "label"], ""), "indicators"),
    (changed(["indicators", 0, "unit"], 5), "indicators"), (changed(["indicators", 0, "source"], "s" * 241), "indicators"),
    (changed(["indicators"], GOOD["indicators"] * 3), "indicators"), (changed(["indicators"], []), "indicator_count"),
    (changed(["indicators"], GOOD["indicators"] * 2), "indicator_count"), (changed(["mode"], "correlation"), "indicator_count"),
    (changed(["mode"], "correlation") | {"indicators": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}]}, None),
    (changed(["filters"], []), "countries"), (changed(["filters", "countries"], "USA"), "countries"),
    (changed(["filters", "countries", 1], 5), "countries"), (changed(["filters", "countries", 1], "A B"), "countries"),
    (changed(["filters", "countries"], ["A"] * 51), "countries"), (changed(["filters", "year"], True), "integers"),
    (changed(["filters", "year"], 2000.0), "integers"), (changed(["filters", "year"], 10001), "integers"),
    (changed(["filters", "rank_end"], "9"), "integers"), (changed(["filters", "order"], "up"), "order"), (changed(["filters", "order"], 1), "order"),
    (changed(["snapshot"], 5), "snapshot"), (changed(["snapshot", "rows"], {}), "snapshot"), (changed(["snapshot", "rows"], [ROW] * 121), "snapshot"),
    (changed(["snapshot", "rows"], [ROW] * 120), None), (changed(["snapshot", "rows"], [ROW] * 119 + [{"value": "1"}]), "rows"),
    (changed(["snapshot", "rows", 0, "rank"], True), "rows"), (changed(["snapshot", "rows", 0, "country_name"], "n" * 121), "rows"),
    (changed(["snapshot", "rows", 0], {"junk": 1}), "rows"), (changed(["snapshot", "rows", 0], [1]), "rows"), (changed(["snapshot", "rows", 0, "x"], None), "rows"),
    (changed(["snapshot", "points", 0, "y"], "2"), "points"), (changed(["snapshot", "statistics", 1, "value"], True), "statistics"),
    (changed(["snapshot", "statistics", 0, "label"], " "), "statistics"), (changed(["snapshot", "statistics", 0], {"label": "x"}), "statistics"),
    (changed(["snapshot", "statistics"], [{"label": "a", "value": 1}] * 9), "snapshot"), (changed(["history", 0, "role"], "system"), "history"),
    (changed(["history", 1, "content"], ""), "history"), (changed(["history", 1, "content"], "c" * 1001), "history"),
    (changed(["history"], GOOD["history"][:1] * 9), "history"), (changed(["history", 0], 7), "history"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(-1, None), (-2, "{not json"), (-3, '{"message": 1e999}')]
    out = payload_check(spark.createDataFrame(rows, "id long, payload string"), ["a", "b"])
    return {r.id: r for r in out.collect()}


def test_first_failing_rule(verdicts):
    assert [(i, verdicts[i].reason) for i in range(len(CASES))] == [(i, reason) for i, (_, reason) in enumerate(CASES)]
    assert all(verdicts[i].valid == (reason is None) for i, (_, reason) in enumerate(CASES))


def test_no_json_and_sizes(verdicts):
    assert verdicts[-1].reason == verdicts[-2].reason == "payload" and verdicts[-3].reason == "message"
    assert (verdicts[0].n_rows, verdicts[0].n_points, verdicts[0].n_statistics) == (1, 1, 2) and verdicts[1].n_rows == 0
