"""Golden micro-fixtures worked out by hand from the reference's code
(FIXTURES.md), run through the operators on tiny DataFrames and files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabulon.operators import admission as Z
from tabulon.operators import dialog as D
from tabulon.operators import ingest as I
from tabulon.operators import library as L
from tabulon.operators import panel as P
from tabulon.operators import search as S
from tabulon.sources import files
from tabulon.sources.dims import FILTER_LEVELS, HEALTH_INDICATORS, REGION_GROUPS


def _panel(spark, rows, ind="x"):
    return spark.createDataFrame([(c, c, y, ind, float(v), "WHO") for c, y, v in rows], P.PANEL_SCHEMA)


GOLDEN_A = [("AAA", 2000, 10), ("AAA", 2001, 15), ("AAA", 2004, 0), ("AAA", 2005, 5),
            ("BBB", 2000, 20), ("BBB", 2001, 15)]


# ------------------------------------------------------------------ panel

def test_year_over_year_bridges_gaps_and_nulls_division_by_zero(spark):
    out = P.year_over_year(_panel(spark, GOLDEN_A)).orderBy("country_code", "year").collect()
    assert [r["change"] for r in out] == [None, 5, -15, 5, None, -5]
    assert [r["pct_change"] for r in out] == [None, 50, -100, None, None, -25]


def test_rankings_positional_with_tie_break_and_range(spark):
    p = _panel(spark, GOLDEN_A)
    r2000 = P.rankings(p, year=2000).orderBy("rank").collect()
    assert [(r["country_code"], r["rank"]) for r in r2000] == [("BBB", 1), ("AAA", 2)]
    r2001 = P.rankings(p, year=2001).orderBy("rank").collect()
    assert [(r["country_code"], r["rank"]) for r in r2001] == [("AAA", 1), ("BBB", 2)]
    rng = P.rankings(p, year=2000, rank_start=2, rank_end=3).collect()
    assert [(r["country_code"], r["rank"]) for r in rng] == [("AAA", 2)]
    with pytest.raises(ValueError):
        P.rankings(p, rank_start=5, rank_end=2)


def test_rank_numbers_have_no_gaps(spark, ):
    rows = [(f"C{i:02d}", 2000, (i * 7) % 5) for i in range(30)]
    out = P.rankings(_panel(spark, rows), year=2000, top_n=30).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 31))


def test_indicator_summary(spark):
    s = P.indicator_summary(_panel(spark, GOLDEN_A)).collect()[0].asDict()
    assert (s["row_count"], s["country_count"], s["year_min"], s["year_max"]) == (6, 2, 2000, 2005)
    assert (s["value_min"], s["value_max"]) == (0, 20)


def test_correlation_goldens(spark):
    a = _panel(spark, GOLDEN_A, "x")
    b = _panel(spark, [("AAA", 2000, 1), ("BBB", 2000, 2), ("CCC", 2000, 9)], "y")
    panel = a.unionByName(b)
    summ, pts = P.correlate(panel, "x", "y", year=2000)
    r = summ.collect()[0]
    assert (r["n"], r["correlation"]) == (2, 1.0) and pts.count() == 2
    summ, _ = P.correlate(panel, "x", "y")
    assert summ.collect()[0]["correlation"] == 1.0
    one = _panel(spark, [("AAA", 2000, 1)], "y")
    summ, pts = P.correlate(a.unionByName(one), "x", "y", year=2000)
    r = summ.collect()[0]
    assert (r["n"], r["correlation"], pts.count()) == (1, None, 0)
    flat = _panel(spark, [("AAA", 2000, 3), ("BBB", 2000, 3)], "x").unionByName(b)
    summ, pts = P.correlate(flat, "x", "y", year=2000)
    r = summ.collect()[0]
    assert (r["n"], r["correlation"], pts.count()) == (2, None, 2)


def test_all_pairs_is_symmetric_and_bounded(spark):
    a = _panel(spark, GOLDEN_A, "x")
    b = _panel(spark, [("AAA", 2000, 1), ("BBB", 2000, 2)], "y")
    c = _panel(spark, [("AAA", 2000, 5), ("BBB", 2000, 1)], "z")
    out = {(r["indicator_a"], r["indicator_b"]): r["correlation"]
           for r in P.correlate_all_pairs(a.unionByName(b).unionByName(c)).collect()}
    assert set(out) == {("x", "y"), ("x", "z"), ("y", "z")}
    assert all(v is None or -1 <= v <= 1 for v in out.values())


def test_filter_is_idempotent_and_empty_list_means_all(spark):
    p = _panel(spark, GOLDEN_A)
    once = P.filter_panel(p, [" aaa", "AAA"], 2001, 2004)
    assert sorted(r["year"] for r in once.collect()) == [2001, 2004]
    assert P.filter_panel(once, ["AAA"], 2001, 2004).count() == once.count()
    assert P.filter_panel(p, [], None, None).count() == 6


# ------------------------------------------------------------- WHO / OWID

def test_dim_feed_goldens(spark, tmp_dir):
    rows = [
        {"SpatialDimType": "COUNTRY", "SpatialDim": "AAA", "TimeDim": 2000, "Dim1": "SEX_BTSX", "NumericValue": 70},
        {"SpatialDimType": "COUNTRY", "SpatialDim": "AAA", "TimeDim": 2000, "Dim1": "SEX_MLE", "NumericValue": 68},
        {"SpatialDimType": "COUNTRY", "SpatialDim": "AAA", "TimeDim": 2000, "Dim1": "SEX_BTSX", "NumericValue": 72},
        {"SpatialDimType": "COUNTRY", "SpatialDim": "BBB", "TimeDim": 2000, "Dim1": "SEX_BTSX",
         "NumericValue": None},
        {"SpatialDimType": "REGION", "SpatialDim": "EUR", "TimeDim": 2000, "Dim1": "SEX_BTSX", "NumericValue": 75},
        {"SpatialDimType": "COUNTRY", "SpatialDim": "ZZZ", "TimeDim": "2001", "Dim1": "SEX_BTSX",
         "NumericValue": "60.5"},
    ]
    second = [{"SpatialDimType": "COUNTRY", "SpatialDim": "AAA", "TimeDim": 2000, "Dim1": "SEX_MLE",
               "NumericValue": 60},
              {"SpatialDimType": "COUNTRY", "SpatialDim": "AAA", "TimeDim": 2000, "Dim1": "SEX_FMLE",
               "NumericValue": 64}]
    p1, p2, pn, pe = (os.path.join(tmp_dir, f) for f in ("a.json", "b.json", "names.json", "empty.json"))
    for path, body in ((p1, rows), (p2, second), (pe, [])):
        with open(path, "w") as f:
            json.dump({"value": body}, f)
    with open(pn, "w") as f:
        json.dump({"value": [{"Code": "AAA", "Title": "Alpha"}]}, f)
    feed = files.json_envelope(spark, p1, indicator_id="ind1").unionByName(
        files.json_envelope(spark, p2, indicator_id="ind2"))
    names = files.code_title_dimension(spark, pn)
    out = {(r["indicator_id"], r["country_code"], r["year"]): (r["country_name"], r["value"])
           for r in I.normalise_dim_feed(feed, names).collect()}
    assert out == {("ind1", "AAA", 2000): ("Alpha", 71.0), ("ind1", "ZZZ", 2001): ("ZZZ", 60.5),
                   ("ind2", "AAA", 2000): ("Alpha", 62.0)}
    empty = files.json_envelope(spark, pe, indicator_id="e")
    assert empty.count() == 0 and "SpatialDim" in empty.columns


def test_entity_feed_daily_latest_and_code_filter(spark, tmp_dir):
    path = os.path.join(tmp_dir, "owid.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("﻿Entity,Code,Day,cases\n"
                "Alpha,AAA,2021-01-05,1\nAlpha,AAA,2021-12-31,9\nAlpha,AAA,2021-06-01,4\n"
                "World,OWID_WRL,2021-01-01,100\nBlank,,2021-01-01,3\nTwo,AA,2021-01-01,5\n")
    feed = files.entity_csv(spark, path)
    out = I.normalise_entity_feed(feed, "cases").collect()
    assert [(r["country_code"], r["year"], r["value"]) for r in out] == [("AAA", 2021, 9.0)]
    with pytest.raises(ValueError):
        I.probe_entity_columns(["Entity", "Code", "value"])
    with pytest.raises(ValueError):
        I.probe_entity_columns(["Entity", "Code", "Year"])


# ------------------------------------------------------------------ songs

SONG_HEADER = ["Track URI", "Track Name", "Artist Name(s)", "Vibe Description", "Genres", "Vibe Tags", "Energy"]


def test_song_import_goldens(spark, tmp_dir):
    path = os.path.join(tmp_dir, "songs.csv")
    rows = [
        ["a:b:K1", "T", "A", "calm", "Pop, rock", "x; Y", "n/a"],
        ["a:b:K1", "T2", "A2", "loud", "ROCK,jazz", "y;z", "0.5"],
        ["", "봄날", "IU", "soft", "", "", ""],
        ["", "T", "", "", "", "", ""],
    ]
    import csv
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(SONG_HEADER)
        w.writerows(rows)
    out = L.import_catalog(files.quoted_csv(spark, path))
    rep = out["report"].collect()[0].asDict()
    assert rep == {"imported": 2, "merged": 1, "skipped": 1, "bad_numbers": 1}
    songs = {r["id"]: r for r in out["songs"].collect()}
    k1 = songs["K1"]
    assert (k1["title"], k1["artist"], k1["vibe"], k1["genres"], k1["tags"], k1["energy"]) == \
        ("T", "A", "calm", "Pop,rock,jazz", "x;Y;z", 0.5)
    assert k1["document"] == "Genres: Pop,rock,jazz. calm Vibe: x;Y;z."
    assert songs["manual:iu-봄날"]["document"] == "soft"
    sk = out["skipped"].collect()[0].asDict()
    assert "line 5: T - (no artist)" in json.dumps(sk, ensure_ascii=False)
    assert "missing artist, vibe description" in json.dumps(sk, ensure_ascii=False) or \
        "artist, vibe description" in json.dumps(sk, ensure_ascii=False)
    bad = out["bad_numbers"].collect()
    assert len(bad) == 1 and "T - A" in json.dumps(bad[0].asDict())


def test_upsert_is_idempotent_and_replaces_whole_rows(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    b = spark.createDataFrame([("b", 20), ("c", 30)], "id string, v int")
    once = L.upsert(t, b)
    twice = L.upsert(once, b)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == \
        [("a", 1), ("b", 20), ("c", 30)]


def test_level_boundaries_are_inclusive_and_null_never_matches(spark):
    df = spark.createDataFrame([(0.4,), (0.7,), (None,), (0.2,)], "energy double")
    low = df.where(S.level_filter(df, {"energy": "low"}, FILTER_LEVELS)).collect()
    med = df.where(S.level_filter(df, {"energy": "medium"}, FILTER_LEVELS)).collect()
    assert sorted(r[0] for r in low) == [0.2, 0.4]
    assert sorted(r[0] for r in med) == [0.4, 0.7]
    with pytest.raises(ValueError):
        S.level_filter(df, {"energy": "extreme"}, FILTER_LEVELS)


# ----------------------------------------------------------------- search

def test_token_scoring_golden(spark):
    facts = spark.createDataFrame(
        [(1, "St Mary", "Chicago", "IL", "HEART FAILURE"), (2, "Other", "Boston", "MA", "KNEE")],
        "seq long, org string, city string, st string, drg string")
    q = spark.createDataFrame([("q", "heart heart in CA a")], "query_id string, text string")
    out = S.token_topk(facts, q, 2, fact_id="seq", hay_cols=["org", "city", "st", "drg"]).orderBy("rank").collect()
    assert [(r["seq"], r["score"], r["rank"]) for r in out] == [(1, 3, 1), (2, 0, 2)]


def test_vector_topk_exclusion_equals_topk_of_complement(spark):
    import math
    vecs = [(i, [math.cos(i / 7.0), math.sin(i / 7.0)]) for i in range(40)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vec array<double>")
    first = S.vector_topk(v, q, 5).select("query_id", "vec_id")
    excl = [r["vec_id"] for r in S.vector_topk(v, q, 5, exclude=first).orderBy("rank").collect()]
    shown = {r["vec_id"] for r in first.collect()}
    rest = [r["vec_id"] for r in S.vector_topk(v.where(~F.col("vec_id").isin(*shown)), q, 5)
            .orderBy("rank").collect()]
    assert excl == rest and not set(excl) & shown


# ----------------------------------------------------------------- dialog

COMMAND_GOLDENS = [
    ("Show ranks 5 through 15 for health expenditure per capita in 2024.",
     ("rankings", "health_expenditure_per_capita", 2024, 5, 15, None, None, None)),
    ("Show life expectancy from 2000 to 2020.", ("trend", "life_expectancy", None, None, None, None, 2000, 2020)),
    ("Show burden of disease for Scandinavia", ("trend", "burden_of_disease", None, None, None, "Scandinavia",
                                                None, None)),
    ("Rank 9 to 3 for GDP per capita", None),
    ("Compare Southeast Asia GDP per capita", ("correlation", "gdp_per_capita", None, None, None,
                                               "Southeast Asia", None, None)),
]


def test_command_goldens(spark):
    msgs = spark.createDataFrame([(i, m, None, None) for i, (m, _) in enumerate(COMMAND_GOLDENS)],
                                 "id int, message string, context_indicator string, context_year int")
    out = D.extract_command(msgs, HEALTH_INDICATORS, REGION_GROUPS).orderBy("id").collect()
    got = [None if r["action"] is None else tuple(r["action"]) for r in out]
    assert got == [e for _, e in COMMAND_GOLDENS]


def test_action_check_region_not_capped_and_codes_override(spark):
    rows = [({"mode": "trend", "indicator_id": "life_expectancy", "region": "Africa"},),
            ({"mode": "rankings", "indicator_id": "life_expectancy", "rank_start": 3},),
            ({"mode": "rankings", "indicator_id": "nope"},)]
    schema = "action struct<mode string, indicator_id string, region string, rank_start int>"
    df = spark.createDataFrame([(dict({"region": None, "rank_start": None}, **r[0]),) for r in rows], schema)
    out = D.action_check(df, [r[0] for r in HEALTH_INDICATORS], REGION_GROUPS).collect()
    assert len(out[0]["valid_action"]["country_codes"]) == 54
    assert (out[1]["valid_action"]["rank_start"], out[1]["valid_action"]["rank_end"]) == (3, 12)
    assert out[2]["valid_action"] is None


def test_history_window_then_clean(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate(
        [("user", "a"), ("assistant", "b"), ("system", "s"), ("user", "  "), ("assistant", " c "), ("user", "d")])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = D.clean_history(df, n=4).orderBy("turn").collect()
    assert [r["content"] for r in out] == ["c", "d"]


def test_record_check(spark):
    recs = ['{"country_code": "AAA", "value": 1.5, "other": true}', '{"value": true}', '{"x": null}',
            '{"k": 1}', '{"country_name": "' + "n" * 121 + '"}', "not json", '{"rank": 3}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "id int, record string")
    out = [r["valid"] for r in D.record_check(df).orderBy("id").collect()]
    assert out == [True, False, False, False, False, False, True]


# -------------------------------------------------------------- admission

def test_admission_golden(spark):
    ts = [0, 10, 20, 60, 61, 65, 71]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(ts)], "event_id long, key string, t long") \
              .withColumn("ts", F.timestamp_seconds("t"))
    out = Z.admission(df, limit=2, window_seconds=60).orderBy("event_id").collect()
    assert [r["admitted"] for r in out] == [True, True, False, False, True, False, True]


def test_admission_never_exceeds_limit_and_is_bounded_by_arrivals(spark):
    rows = [(i, f"k{i % 3}", (i * 37) % 500) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    dec = Z.admission(df, limit=3, window_seconds=60)
    adm = dec.where("admitted").select("key", "t").collect()
    by_key = {}
    for r in adm:
        by_key.setdefault(r["key"], []).append(r["t"])
    for stamps in by_key.values():
        stamps.sort()
        for i, t in enumerate(stamps):
            assert sum(1 for s in stamps[: i + 1] if s >= t - 60) <= 3
    arr = Z.arrivals_in_window(df, window_seconds=60)
    assert dec.where("admitted").count() <= df.count()
    assert arr.agg(F.min("arrivals")).first()[0] >= 1


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)],
                               "fwd string, remote string")
    assert [r[0] for r in df.select(Z.client_key(F.col("fwd"), F.col("remote"))).collect()] == \
        ["1.2.3.4", "9.9.9.9", "unknown"]


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_dir):
    from tabulon.streaming.admission_stream import admission_stream, run_to_table
    src = os.path.join(tmp_dir, "events")
    rows = [(i, f"k{i % 4}", 1_700_000_000 + i * 7) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, key string, t long") \
              .withColumn("ts", F.timestamp_seconds("t")).drop("t")
    # time-ordered files, one per micro-batch
    for j in range(4):
        df.where((F.col("event_id") >= j * 100) & (F.col("event_id") < (j + 1) * 100)).coalesce(1) \
          .write.mode("append").parquet(src)
    batch = {r["event_id"]: r["admitted"] for r in Z.admission(df, limit=3, window_seconds=60).collect()}
    out = run_to_table(spark, src, df.schema, lambda s: admission_stream(s, limit=3, window_seconds=60),
                       max_files_per_trigger=1, out_root=os.path.join(tmp_dir, "out"), files_in_time_order=True)
    stream = {r["event_id"]: r["admitted"] for r in out.collect()}
    assert stream == batch


# ------------------------------------------------------------------ plans

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rankings_plan_has_group_limit(spark):
    rows = [(f"C{i:02d}", 2000, float(i)) for i in range(50)]
    p = spark.createDataFrame([(c, c, y, "x", v, "WHO") for c, y, v in rows], P.PANEL_SCHEMA)
    assert "WindowGroupLimit" in _plan(P.rankings(p, top_n=5))


def test_scan_pushes_filters_and_prunes_columns(spark):
    from tests.conftest import SF_SMALL
    from tabulon.plans.derive import nation_year_panel
    df = P.filter_panel(nation_year_panel(spark, SF_SMALL), None, 1996, 1997)
    plan = _plan(df)
    assert "PushedFilters" in plan
    assert "o_orderpriority" not in plan  # unused columns pruned from the scan


# ----------------------------------------------------------------- housing

def test_nested_case_scan_measures_and_gaps(spark, tmp_dir):
    from tabulon.operators import scoring as K
    path = os.path.join(tmp_dir, "cases.json")
    peers = [
        {"name": "A", "population": "698k ($107,799)", "affordability": 40.0, "access": 75.8,
         "value": "$298,000 (2.76x)"},
        {"name": "B", "population": "12k ($9,000)", "affordability": 30.0, "access": 38.7, "value": "Not supplied"},
    ]
    with open(path, "w") as f:
        json.dump([{"label": "X affordability", "target": "A", "reference": "B", "peers": peers}], f)
    rows = files.nested_cases(spark, path)
    rows = rows.withColumn("affordability", F.col("affordability").cast("double")) \
               .withColumn("access", F.col("access").cast("double")).withColumn("units", F.lit(1.0))
    parsed = rows.select("peer_pos", K.parse_measure(F.col("population")).alias("p"),
                         K.parenthetical_measure(F.col("population")).alias("q"),
                         K.parse_measure(F.col("value")).alias("v")).orderBy("peer_pos").collect()
    assert [(r["p"], r["q"], r["v"]) for r in parsed] == [(698000.0, 107799.0, 298000.0), (12000.0, 9000.0, None)]
    gap = K.target_reference_gaps(rows).collect()[0]
    assert (gap["other_axis"], gap["other_axis_gap"]) == ("access", 37.1)
    flags = K.peer_table(rows).orderBy("peer_pos").collect()
    assert [(r["is_focal"], r["is_reference"]) for r in flags] == [(True, False), (False, True)]


def test_save_playlists_assigns_ids_and_rejects_empty(spark):
    schema = "id string, name string, query string, tracks array<long>, created_at string, updated_at string"
    existing = spark.createDataFrame([("p1", "old", "q", [1, 2], "2024-01-01", "2024-01-01")], schema)
    batch = spark.createDataFrame([("p1", "renamed", "q", [3], "2024-01-01", None),
                                   (None, "new", "q2", [4, 5], None, None),
                                   (None, "empty", "q3", [], None, None)], schema)
    saved = {r["name"]: r for r in L.save_playlists(existing, batch, "2024-02-01").collect()}
    assert set(saved) == {"renamed", "new"}
    assert saved["renamed"]["created_at"] == "2024-01-01" and saved["renamed"]["updated_at"] == "2024-02-01"
    assert len(saved["new"]["id"]) == 8 and saved["new"]["created_at"] == "2024-02-01"
    rejected = L.rejected_playlists(batch).collect()
    assert [r["name"] for r in rejected] == ["empty"]


def test_string_csv_keeps_text_and_json_sink_bounds_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "costs.csv")
    with open(src, "w", encoding="utf-8") as f:
        f.write('DRG_Cd,DRG_Desc,Tot_Dschrgs\n"001","HEART, FAILURE",0012\n"002","Multi\nline",7\n')
    df = files.string_csv(spark, src, ["DRG_Cd", "DRG_Desc", "Tot_Dschrgs"])
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("001", "HEART, FAILURE", "0012"), ("002", "Multi\nline", "7")]
    out = os.path.join(tmp_dir, "json_out")
    big = spark.range(25).withColumn("x", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id") * 1.5))
    files.write_json_records(big.coalesce(1), out, max_records_per_file=10)
    parts = [p for p in os.listdir(out) if p.startswith("part-")]
    assert len(parts) == 3
    recs = [json.loads(line) for p in parts for line in open(os.path.join(out, p))]
    assert len(recs) == 25 and {r["id"]: r["x"] for r in recs}[3] is None


def test_all_pairs_blocked_equals_single_pass(spark, monkeypatch):
    import random
    rnd = random.Random(7)
    rows = [(f"C{c}", f"C{c}", 2000, f"i{i}", float(rnd.randint(0, 9)), "S")
            for c in range(6) for i in range(8) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, P.PANEL_SCHEMA)
    single = sorted(tuple(r) for r in P.correlate_all_pairs(df).collect())
    monkeypatch.setattr(P, "PAIR_BLOCK", 3)
    blocked = sorted(tuple(r) for r in P.correlate_all_pairs(df).collect())
    assert len(single) == 28 and single == blocked


def test_panel_table_partitioned_by_indicator_prunes(spark, tmp_dir):
    from tests.conftest import SF_SMALL
    from tabulon.plans.derive import nation_year_panel
    path = os.path.join(tmp_dir, "panel")
    files.write_table(nation_year_panel(spark, SF_SMALL), path, partition_by=["indicator_id"])
    stored = spark.read.parquet(path)
    ranked = P.rankings(stored.where(F.col("indicator_id") == "revenue"), year=1996, top_n=3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(indicator_id" in plan and "revenue" in plan
    assert ranked.count() == 3


def test_bucketed_prefix_scans_equal_plain_windows_with_hot_and_null_keys(spark):
    from pyspark.sql import Window
    from tabulon.operators import prefix as PF
    from tests.conftest import SF_SMALL
    ev = (spark.read.parquet(f"{SF_SMALL}/events.parquet")
               .withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
               .withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                           .when(F.col("event_id") % 97 == 1, F.lit(None)).otherwise(F.col("user_id"))))
    w = Window.partitionBy("user_id").orderBy("_us", "event_id")
    a = PF.running_max(ev, "user_id", ["_us", "event_id"], "_us", "value", "rm", buckets=8).select("event_id", "rm")
    b = ev.withColumn("rm", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("event_id", "rm")
    assert a.count() == ev.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    gap = 6 * 3600 * 1_000_000
    s1 = PF.gap_segments(ev, "user_id", ["_us", "event_id"], "_us", gap, "seg", buckets=8).select("event_id", "seg")
    new = F.when(F.col("_us") - F.lag("_us").over(w) > gap, 1).otherwise(0)
    s2 = (ev.withColumn("_n", new).withColumn("seg", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .select("event_id", "seg"))
    assert s1.count() == ev.count() and s1.exceptAll(s2).count() == 0
    for width in (60 * 1_000_000, 5 * 86400 * 1_000_000):
        r1 = PF.range_count(ev, "user_id", "_us", width, "arr", buckets=8).select("event_id", "arr")
        wr = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-width, 0)
        r2 = ev.withColumn("arr", F.count(F.lit(1)).over(wr)).select("event_id", "arr")
        assert r1.count() == ev.count() and r1.exceptAll(r2).count() == 0


def test_measure_shares_keeps_every_share(spark):
    from tabulon.operators import scoring as K
    rows = [("10% / 81% / 8%",), ("0.5%/99.5%",), ("698k ($107,799)",), ("46%",), ("Not supplied",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "x string").select(K.measure_shares(F.col("x")).alias("s")).collect()]
    assert got == [[10.0, 81.0, 8.0], [0.5, 99.5], None, None, None, None]
