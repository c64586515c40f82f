"""Property tests: each generated batch of cases is evaluated in one Spark job
and compared with a plain-Python statement of the reference's semantics."""

import math

import pytest
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions.text import ordered_ci_union
from tabulon.operators import scoring as K

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def py_union(lists):
    """Split on ',', strip, drop blanks, case-insensitive distinct, first
    spelling and position win (the reference's list merge)."""
    out, seen = [], set()
    for text in lists:
        for item in text.split(","):
            item = item.strip()
            if item and item.lower() not in seen:
                seen.add(item.lower())
                out.append(item)
    return out


words = st.sampled_from(["Pop", "pop", " rock", "ROCK ", "jazz", "", "  ", "K-pop", "indie", "Indie"])
texts = st.lists(words, min_size=0, max_size=5).map(lambda xs: ",".join(xs))


@SETTINGS
@given(st.lists(st.lists(texts, min_size=1, max_size=4), min_size=1, max_size=20))
def test_ordered_union_matches_python_and_is_idempotent(spark, cases):
    rows = [(i, [t for t in case]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    items = F.flatten(F.transform(F.col("texts"), lambda t: F.split(t, ",")))
    once = df.select("id", ordered_ci_union(items).alias("u"))
    twice = once.select("id", "u", ordered_ci_union(F.col("u")).alias("uu"))
    got = {r["id"]: (r["u"], r["uu"]) for r in twice.collect()}
    for i, case in enumerate(cases):
        u, uu = got[i]
        assert list(u) == py_union(case)
        assert list(uu) == list(u)


def js_score(ratings, weights):
    total = sum(weights)
    if total == 0:
        return None
    s = sum(w * r / 5 for r, w in zip(ratings, weights))
    return math.floor(s / total * 100 + 0.5)


@SETTINGS
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=5, max_size=5),
                          st.lists(st.sampled_from([0, 5, 10, 20, 50, 100]), min_size=5, max_size=5)),
                min_size=1, max_size=30))
def test_weighted_score_range_and_rounding(spark, cases):
    rows = [(i, [float(x) for x in r], [float(x) for x in w]) for i, (r, w) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, r array<double>, w array<double>")
    got = {x["id"]: x["s"] for x in df.select("id", K.weighted_score(F.col("r"), F.col("w")).alias("s")).collect()}
    for i, (r, w) in enumerate(cases):
        assert got[i] == js_score(r, w)
        if got[i] is not None:
            assert 20 <= got[i] <= 100


@SETTINGS
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=3, max_size=3),
                          st.lists(st.integers(1, 3), min_size=3, max_size=3)), min_size=1, max_size=30))
def test_capacity_rating_bounds(spark, cases):
    rows = [(i, tiers, req) for i, (tiers, req) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, tiers array<int>, req array<int>")
    got = {x["id"]: x["c"] for x in df.select("id", K.capacity_rating(F.col("req"), F.col("tiers")).alias("c"))
           .collect()}
    for i, (tiers, req) in enumerate(cases):
        base = 4 + sum((t > n) - (t < n) for t, n in zip(tiers, req)) / 2
        want = max(1.0, min(5.0, base))
        if any(t < n for t, n in zip(tiers, req)):
            want = min(want, 2.0)
        assert got[i] == want


def test_late_events_in_a_stream_are_flagged_not_dropped(spark, tmp_path):
    from tabulon.streaming.admission_stream import admission_stream, run_to_table
    src = str(tmp_path / "events")
    schema = "event_id long, key string, t long"
    first = spark.createDataFrame([(0, "k", 1000), (1, "k", 1010)], schema)
    late = spark.createDataFrame([(2, "k", 1005), (3, "k", 1100)], schema)
    for part in (first, late):
        part.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(src)
    full_schema = spark.read.parquet(src).schema
    out = run_to_table(spark, src, full_schema, lambda s: admission_stream(s, limit=5, window_seconds=60),
                       max_files_per_trigger=1, files_in_time_order=True, out_root=os.path.join(str(tmp_path), "out"))
    status = {r["event_id"]: r["status"] for r in out.collect()}
    assert status == {0: "admitted", 1: "admitted", 2: "late", 3: "admitted"}


def py_float_or_none(text):
    try:
        v = float(text)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(v) or math.isinf(v) else v


number_texts = st.one_of(
    st.text(alphabet="0123456789.eE+-_ dfx\tn", max_size=8),
    st.floats(allow_nan=False, allow_infinity=False).map(repr),
    st.sampled_from(["1d", "1_000", "0x1p3", "nan", "Infinity", " 7 ", "\t3\n", "1.e5", "12 34", ""]))


@SETTINGS
@given(st.lists(number_texts, min_size=1, max_size=60))
def test_lenient_double_matches_python_float(spark, texts):
    from tabulon.functions.numeric import lenient_double
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", lenient_double(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_float_or_none(t), t


def test_stream_byte_budget_splits_batches_and_equals_batch(spark, tmp_path):
    from tabulon.operators import admission as Z
    from tabulon.streaming.admission_stream import admission_stream, run_to_table
    src = str(tmp_path / "events")
    rows = [(i, f"k{i % 3}", 1_700_000_000 + i * 11) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, key string, t long") \
              .withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for j in range(3):
        df.where((F.col("event_id") >= j * 100) & (F.col("event_id") < (j + 1) * 100)).coalesce(1) \
          .write.mode("append").parquet(src)
    batch = {r["event_id"]: r["admitted"] for r in Z.admission(df, limit=2, window_seconds=60).collect()}
    out = run_to_table(spark, src, df.schema, lambda s: admission_stream(s, limit=2, window_seconds=60),
                       out_root=str(tmp_path / "out"), max_bytes_per_trigger=1, files_in_time_order=True)
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == batch


def test_every_event_of_many_batches_comes_out_once(spark, tmp_path):
    """Far older events of known and of new keys, over five micro-batches."""
    import time

    from tabulon.streaming.admission_stream import admission_stream, run_to_table
    src = str(tmp_path / "events")
    batches = [[(0, "k", 100_000)], [(1, "k", 200_000), (2, "j", 200_000)], [(3, "k", 100), (4, "new", 50)],
               [(5, "j", 300_000)], [(6, "new", 10), (7, "k", 300_000)]]
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, key string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t") \
             .coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    schema = spark.read.parquet(src).schema
    out = run_to_table(spark, src, schema, lambda s: admission_stream(s, limit=5, window_seconds=60), max_files_per_trigger=1,
                       files_in_time_order=True, out_root=str(tmp_path / "out"))
    assert sorted((r["event_id"], r["status"]) for r in out.collect()) == [
        (0, "admitted"), (1, "admitted"), (2, "admitted"), (3, "late"), (4, "admitted"), (5, "admitted"), (6, "late"),
        (7, "admitted")]


def test_limits_need_files_in_time_order(spark, tmp_path):
    from tabulon.streaming.admission_stream import admission_stream, run_to_table
    with pytest.raises(ValueError, match="event-time order"):
        run_to_table(spark, str(tmp_path), None, admission_stream, max_bytes_per_trigger=1)


def test_admission_ring_matches_counting():
    import random

    import numpy as np

    from tabulon.operators.admission import admit_sequence
    rng = random.Random(1)
    for _ in range(300):
        limit, window = rng.randint(1, 5), rng.randint(1, 30)
        ts = sorted(rng.randint(0, 120) for _ in range(rng.randint(0, 60)))
        admitted, want = [], []
        for t in ts:
            want.append(sum(a >= t - window for a in admitted) < limit)
            if want[-1]:
                admitted.append(t)
        assert admit_sequence(np.array(ts, dtype=np.int64), limit, window)[0].tolist() == want


def test_collapse_keeps_rows_without_a_key(spark):
    from tabulon.operators.ingest import collapse_totals
    rows = [("a", "T", 1), ("a", "x", 2), ("b", "x", 3), (None, "T", 4), (None, "x", 5), (None, None, 6)]
    got = collapse_totals(spark.createDataFrame(rows, "indicator_id string, d string, v int"), [("d", "T")])
    assert got.columns == ["indicator_id", "d", "v"] and sorted(r.v for r in got.collect()) == [1, 3, 4, 6]


def test_upsert_keeps_one_row_a_key(spark):
    from tabulon.operators.library import upsert
    table = spark.createDataFrame([("a", 1), ("z", 2)], "id string, v int")
    batch = spark.createDataFrame([("a", 7, 0), ("a", 5, 1), ("b", 3, 2)], "id string, v int, n int")
    assert sorted(map(tuple, upsert(table, batch, seq="n").collect())) == [("a", 5), ("b", 3), ("z", 2)]
    assert sorted(map(tuple, upsert(table, batch.drop("n")).collect())) == [("a", 7), ("b", 3), ("z", 2)]


def test_equal_new_playlists_get_ids_of_their_own(spark):
    from tabulon.operators.library import save_playlists
    schema = "id string, name string, query string, tracks array<string>, created_at string, updated_at string"
    new = [(None, "n", "q", ["a"], None, None), (None, "n", "q", ["b"], None, None), (None, "n", "q", [], None, None)]
    out = save_playlists(spark.createDataFrame([], schema), spark.createDataFrame(new, schema), "2024-01-01").collect()
    assert len(out) == 2 and len({r.id for r in out}) == 2


def test_level_filter_reports_unknown_levels():
    from tabulon.operators.search import level_filter
    with pytest.raises(ValueError, match="energy=loud, mood=odd"):
        level_filter(None, {"mood": "odd", "energy": "loud", "tempo": None}, {"energy": {"low": (0, 1)}})
    assert level_filter(None, {"energy": ""}, {}) is None


def test_edges_of_codes_names_and_positions(spark):
    from tabulon.operators import dialog as D
    from tabulon.operators.ingest import normalise_entity_feed
    codes = spark.createDataFrame([("USA\n",), ("USA",)], "c string").select(F.col("c").rlike(D.COUNTRY_CODE_PATTERN).alias("ok"))
    assert [r.ok for r in codes.collect()] == [False, True]
    feed = spark.createDataFrame([("X", "N/A", "2020-01-01", "1"), ("X", "nan", "2020-01-01", "1"), (None, "FRA", "2020-01-01", "2"),
                                  ("France", "FRA", "2020-01-02", "3")], "Entity string, Code string, Day string, v string")
    assert [(r.country_code, r.value) for r in normalise_entity_feed(feed, "i").collect()] == [("FRA", 3.0)]
    history = spark.createDataFrame([(1, 1_700_000_000_000, "user", "old")], "conv_id long, turn long, role string, content string")
    current = spark.createDataFrame([(1, "new")], "conv_id long, message string")
    out = D.history_with_current(history, current).orderBy("position").collect()
    assert [r.content for r in out] == ["old", "new"]


def test_budget_rejects_when_the_summary_is_too_big(spark):
    from tabulon.operators.dialog import budgeted_context
    rows = [("r", "FRA", "France", 2000 + i, "i", 1.5) for i in range(40)]
    sel = spark.createDataFrame(rows, "request_id string, country_code string, country_name string, year int, indicator_id string, value double")
    verdict = lambda n: budgeted_context(sel, max_chars=n).first().decision
    assert (verdict(1), verdict(400), verdict(400_000)) == ("reject", "summary", "raw")


def test_strict_numbers_fail_the_job(spark):
    from tabulon.operators.library import strict_double
    good = spark.createDataFrame([("1",), (" 2.5 ",), (None,), ("inf",)], "t string")
    assert [r.v for r in good.select(strict_double(F.col("t")).alias("v")).collect()] == [1.0, 2.5, None, float("inf")]
    with pytest.raises(Exception, match="could not convert"):
        spark.createDataFrame([("1d",)], "t string").select(strict_double(F.col("t")).alias("v")).collect()
