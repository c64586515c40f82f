"""Admission control on keys that never pause, without times, and as a stream;
bucketed scans with any number of buckets."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators import activity as A
from tabulon.operators import admission as Z
from tabulon.operators import prefix as PF
from tabulon.streaming.admission_stream import admission_stream, run_to_table

LIMIT, WINDOW = 3, 60


def plain(rows):
    """The rule itself, event by event."""
    out, state = {}, {}
    for i, key, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        kept = deque(s for s in state.get(key, ()) if s >= t - WINDOW)
        out[i] = len(kept) < LIMIT
        if out[i]:
            kept.append(t)
        state[key] = kept
    return out | {r[0]: False for r in rows if r[2] is None}


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))


def traffic(regular):
    """A key with a third of the rows and no gap, a null key, and small keys with gaps and ties."""
    rng = random.Random(4)
    rows, t = [], 1_700_000_000
    for _ in range(900):
        t += 7 if regular else rng.choice((0, 1, 3, 9, 25))
        rows.append(("hot", t))
    rows += [(rng.choice((None, "a", "b", "c")), 1_700_000_000 + rng.randrange(30_000)) for _ in range(1800)]
    rows += [("hot", None), (None, None), ("z", None)]
    return [(i, k, t) for i, (k, t) in enumerate(rows)]


@pytest.mark.parametrize("regular", [False, True])
@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_a_key_that_never_pauses(spark, regular, buckets):
    rows = traffic(regular)
    got = Z.admission(frame(spark, rows), limit=LIMIT, window_seconds=WINDOW, buckets=buckets).collect()
    assert {r.event_id: r.admitted for r in got} == plain(rows) and len(got) == len(rows)
    assert {r.event_id for r in got if r.status == "invalid"} == {i for i, _, t in rows if t is None}


def test_states_that_never_meet_are_walked_in_order(spark, monkeypatch):
    monkeypatch.setattr(Z, "ROUNDS", 1)
    rows = traffic(True)
    got = Z.admission(frame(spark, rows), limit=LIMIT, window_seconds=WINDOW, buckets=16).collect()
    assert {r.event_id: r.admitted for r in got} == plain(rows) and len(got) == len(rows)


def test_buckets_follow_the_measured_rows(spark, monkeypatch):
    monkeypatch.setattr(PF, "ROWS_PER_BUCKET", 100)
    monkeypatch.setattr(Z, "ROWS_PER_BUCKET", 100)
    rows = traffic(False)
    df = frame(spark, rows)
    sizes = {r.key: r.n for r in PF.with_buckets(df, "key", "t").groupBy("key").agg(F.countDistinct("_bucket").alias("n")).collect()}
    assert 7 <= sizes["hot"] <= 9 and sizes["z"] == 1
    got = Z.admission(df, limit=LIMIT, window_seconds=WINDOW).collect()
    assert {r.event_id: r.admitted for r in got} == plain(rows)


def test_empty_table(spark):
    df = frame(spark, traffic(False)).limit(0)
    assert Z.admission(df, buckets=4).collect() == [] and Z.admission(df).collect() == []


def test_stream_and_batch_agree_on_events_without_a_time(spark, tmp_dir):
    rows = [r for r in traffic(False) if r[1] is not None]
    df = frame(spark, rows).drop("t")
    src = os.path.join(tmp_dir, "events")
    df.write.parquet(src)
    out = run_to_table(spark, src, df.schema, lambda s: admission_stream(s, limit=LIMIT, window_seconds=WINDOW),
                       out_root=os.path.join(tmp_dir, "out"))
    batch = Z.admission(df, limit=LIMIT, window_seconds=WINDOW)
    assert {(r.event_id, r.admitted, r.status) for r in out.collect()} == {(r.event_id, r.admitted, r.status) for r in batch.collect()}


def test_several_micro_batches_need_files_in_time_order(spark, tmp_dir):
    with pytest.raises(ValueError, match="event-time order"):
        run_to_table(spark, tmp_dir, frame(spark, []).schema, admission_stream, max_files_per_trigger=1)


@pytest.mark.parametrize("buckets", [1, 8, 512, None])
def test_scans_are_equal_at_any_number_of_buckets(spark, buckets):
    df = frame(spark, traffic(False)).withColumn("value", (F.col("event_id") * 7919 % 1009).cast("double"))
    w = Window.partitionBy("key").orderBy("t", "event_id")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    a = PF.running_max(df, "key", ["t", "event_id"], "t", "value", "x", buckets).select("event_id", "x")
    assert sorted(map(str, a.collect())) == sorted(map(str, df.select("event_id", best.alias("x")).collect()))
    seen = F.count("*").over(Window.partitionBy("key").orderBy("t").rangeBetween(-50, 0))
    b = PF.range_count(df, "key", "t", 50, "x", buckets).select("event_id", "x")
    assert sorted(map(str, b.collect())) == sorted(map(str, df.select("event_id", seen.alias("x")).collect()))
    events = df.where("t is not null").withColumn("day", F.floor(F.col("t") / 500)).withColumnRenamed("key", "user_id")
    s = events.groupBy("user_id", "day").agg(F.max("value").alias("s"), F.min("ts").alias("started"))
    plain_best = F.max("s").over(Window.partitionBy("user_id").orderBy("started", "day").rowsBetween(Window.unboundedPreceding, 0))
    c = A.session_best(events, buckets=buckets).select("user_id", "day", "best_so_far")
    assert sorted(map(str, c.collect())) == sorted(map(str, s.select("user_id", "day", plain_best.alias("best_so_far")).collect()))
