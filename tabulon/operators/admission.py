"""Sliding-window admission control (Z1) and sliding arrival counts.

Z1 per key: drop stamps older than ``now - window`` (a stamp exactly
``window`` old still counts); with ``limit`` or more left the event is
rejected *and not recorded*, otherwise recorded and admitted.  Rejections
feed back into later decisions, so this is not a window aggregate; it is a
small state machine run over each key's events in (ts, id) order.

Batch plan (no group is ever materialised):

1. ``seg`` splits every key's timeline at idle gaps longer than the window:
   the state is provably empty after such a gap, so segments are independent
   and a hot key's work spreads over many tasks.  The segment numbers come
   from a bucketed prefix scan (``operators.prefix``), so even this step
   never runs a key's whole timeline in one task.
2. hash-repartition on (key, seg, bucket), sort within partitions, then
   ``mapInPandas`` walks the Arrow batches carrying at most ``limit`` stamps
   of state; memory is bounded by the batch size plus the limit.
3. A segment of several buckets (a key that never pauses) is speculative: its
   buckets run from the empty state first.  Then every bucket whose true
   entering state differs from the one it ran from walks its rows with both
   states, until they agree; from there on the first decisions hold.  That is
   repeated while a bucket's final state changed, ``ROUNDS`` times at most;
   segments that still change (traffic so regular that states never meet) are
   walked once from their first changed bucket on, bucket after bucket in one
   task, in batches.

Events without a time are ``invalid``: not admitted and never in the state.

Z2 is the feedback-free upper bound, the range count
``count(*) over (partition by key order by ts range window preceding)``,
computed per (key, time bucket) with a one-window halo so a hot key is
split as well.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.prefix import ROWS_PER_BUCKET, gap_segments, range_count
from tabulon.session import cut_lineage

# Fixed values that must equal the reference's for identical results.
LIMIT = 20
WINDOW_SECONDS = 60
DEFAULT_KEY = "unknown"
# end of fixed values

US = 1_000_000


def client_key(forwarded: Column, remote: Column) -> Column:
    """Key = first entry of the forwarded-for list (if the header is
    present), else the remote address, else 'unknown'; trimmed."""
    raw = F.coalesce(forwarded, F.coalesce(remote, F.lit(DEFAULT_KEY)))
    return F.trim(F.element_at(F.split(raw, ",", 2), 1))


def event_micros(ts: str) -> Column:
    """Event time as integer microseconds (exact comparisons, UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _check(limit: int, window_seconds: float) -> tuple[int, int]:
    if int(limit) < 1:
        raise ValueError("limit must be >= 1")
    if window_seconds <= 0:
        raise ValueError("window must be positive")
    return int(limit), int(round(window_seconds * US))


def admit_sequence(ts_us: np.ndarray, limit: int, window_us: int, stamps: deque | None = None):
    """One key's time-ordered stamps: admitted flags, and the state that goes on.

    The state is a ring of the last ``limit`` admitted stamps.  An event is
    rejected exactly when the ring is full and its oldest stamp is still
    inside the window: then ``limit`` admitted events are."""
    ring: deque = deque(stamps or (), maxlen=limit)
    times = ts_us.tolist()
    out = np.zeros(len(times), dtype=bool)
    for i, t in enumerate(times):
        out[i] = len(ring) < limit or t - ring[0] > window_us
        if out[i]:
            ring.append(t)  # a full ring drops its oldest stamp
    return out, ring


# Rounds of corrections before segments that still change are walked in order.
ROUNDS = 3
EVENT, STATE = 1, 0


def _inside(stamps, t: int, window_us: int) -> list:
    """The stamps that still count at time ``t``."""
    return [s for s in stamps if t - s <= window_us]


class _Walk:
    """One bucket's state machine: from the state it really enters with, next
    to the one it ran from before, until both agree."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us
        self.ring: deque = deque(maxlen=limit)
        self.before: deque | None = None   # the earlier run's state; None: no earlier run
        self.end: list = []                # the earlier run's final state
        self.agreed = False

    def enter(self, state, used, end) -> None:
        self.ring.extend([] if state is None else [int(s) for s in state])
        if used is not None:
            self.before = deque((int(s) for s in used), maxlen=self.limit)
            self.end = [int(s) for s in end]

    def step(self, times: np.ndarray, known: np.ndarray) -> np.ndarray:
        if self.before is None:
            out, self.ring = admit_sequence(times, self.limit, self.window_us, self.ring)
            return out
        out = known.copy()
        for i, t in enumerate(times.tolist()):
            if self.agreed:
                break
            for ring, mine in ((self.ring, True), (self.before, False)):
                ok = len(ring) < self.limit or t - ring[0] > self.window_us
                if ok:
                    ring.append(t)
                if mine:
                    out[i] = ok
            self.agreed = _inside(self.ring, t, self.window_us) == _inside(self.before, t, self.window_us)
        return out

    def final(self) -> list:
        return self.end if self.agreed else list(self.ring)


def _walk_fn(limit: int, window_us: int, states: bool):
    """Rows sorted by (_g, _kind, time): a group's state row, if any, before its
    events.  Gives every event its ``admitted`` and, with ``states``, every group
    one state row with the final state and the one it entered with."""
    def fn(batches):
        cur, walk, entered, tail = None, _Walk(limit, window_us), [], None

        def closed(rows: pd.DataFrame, ends: list, used: list) -> pd.DataFrame:
            return rows.assign(_kind=STATE, admitted=None, _end=pd.Series(ends, index=rows.index, dtype=object),
                               _used=pd.Series(used, index=rows.index, dtype=object))

        for pdf in batches:
            if pdf.empty:
                continue
            group = pdf["_g"].to_numpy()
            kind = pdf["_kind"].to_numpy() if "_kind" in pdf else np.full(len(pdf), EVENT)
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist() + [len(pdf)]
            flags = pdf["admitted"].to_numpy(dtype=object).copy() if "admitted" in pdf else np.empty(len(pdf), dtype=object)
            times = pdf["_us"].to_numpy(dtype=np.int64)
            last, ends, used = [], [], []
            for a, b in zip(edges, edges[1:]):
                if group[a] != cur:
                    if cur is not None and states:
                        if a:
                            last.append(a - 1)
                            ends.append(walk.final())
                            used.append(entered)
                        else:
                            yield closed(tail, [walk.final()], [entered])
                    cur, walk, entered = group[a], _Walk(limit, window_us), []
                if kind[a] == STATE:
                    row = pdf.iloc[a]
                    entered = [] if row["_state"] is None else [int(s) for s in row["_state"]]
                    walk.enter(row["_state"], row["_used"], row["_end"])
                    a += 1
                if a < b:
                    known = np.array([bool(x) for x in flags[a:b]]) if walk.before is not None else np.zeros(b - a, dtype=bool)
                    flags[a:b] = walk.step(times[a:b], known)
            tail = pdf.iloc[-1:]
            if last:
                yield closed(pdf.iloc[last], ends, used)
            yield pdf.assign(admitted=flags)[kind == EVENT]
        if cur is not None and states:
            yield closed(tail, [walk.final()], [entered])
    return fn


def idle_segments(events: DataFrame, key: str, order: list[str], window_us: int, buckets: int | None = None) -> DataFrame:
    """Adds ``_seg``, the running count of gaps longer than the window in the
    key's timeline, and ``_bucket``, the row's bucket.  Computed as a bucketed
    prefix scan (per-key time buckets plus a carry from earlier buckets), so a
    hot key's timeline is processed by many tasks, not one window partition."""
    return gap_segments(events, key, order, "_us", window_us, "_seg", buckets, keep_bucket=True)


def admission(events: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id",
              limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS,
              num_partitions: int | None = None, buckets: int | None = None) -> DataFrame:
    """Z1 over a whole table: every input row plus ``admitted`` and ``status``
    (admitted, rejected, or invalid without a time).  ``buckets`` sets the
    number of buckets of every key, which otherwise follows its rows; the
    result is the same for any."""
    limit, window_us = _check(limit, window_seconds)
    base = events.withColumn("_k", F.col(key)).withColumn("_us", event_micros(ts))
    timed = base.where(F.col("_us").isNotNull())
    seg = idle_segments(timed, "_k", ["_us", tie], window_us, buckets)
    names = events.columns

    # Working columns: the group a task walks and, where groups depend on each other, the states of its state row.
    rows = seg.withColumn("_g", F.to_json(F.struct("_k", "_seg", "_bucket"), {"ignoreNullFields": "false"}))
    decided = T.StructField("admitted", T.BooleanType())

    def walk(df: DataFrame, states: bool = True) -> DataFrame:
        parts = df.repartition(num_partitions, "_g") if num_partitions else df.repartition("_g")
        kind = ["_kind"] if "_kind" in df.columns else []
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != "admitted"] + [decided])
        return parts.sortWithinPartitions("_g", *kind, "_us", tie).mapInPandas(_walk_fn(limit, window_us, states), schema)

    if _several_buckets(timed, buckets):
        stamps = F.lit(None).cast("array<bigint>")
        rows = rows.withColumns({"_kind": F.lit(EVENT), "_state": stamps, "_used": stamps, "_end": stamps})
        out = _settle(cut_lineage(walk(rows)), walk, window_us)
    else:
        out = walk(rows, states=False)
    status = F.when(F.col("admitted"), F.lit("admitted")).otherwise(F.lit("rejected"))
    bad = base.where(F.col("_us").isNull()).select(*names, F.lit(False).alias("admitted"), F.lit("invalid").alias("status"))
    return out.select(*names, "admitted", status.alias("status")).unionByName(bad)


def _several_buckets(timed: DataFrame, buckets: int | None) -> bool:
    """Whether any key is cut into several buckets."""
    if buckets is not None:
        return buckets > 1
    return not timed.groupBy("_k").count().where(F.col("count") > ROWS_PER_BUCKET).isEmpty()


def _settle(out: DataFrame, walk, window_us: int) -> DataFrame:
    """Corrects the buckets that did not enter with their true state."""
    order = Window.partitionBy("_k", "_seg").orderBy("_bucket")
    empty = F.array().cast("array<bigint>")

    def changed(df: DataFrame) -> DataFrame:
        """State rows of the buckets whose true entering state differs, where it still counts, from the one used."""
        starts = df.where(F.col("_kind") == EVENT).groupBy("_g").agg(F.min("_us").alias("_first"))
        states = df.where(F.col("_kind") == STATE).join(starts, "_g")
        true = F.coalesce(F.lag("_end").over(order), empty)
        live = [F.filter(c, lambda s: F.col("_first") - s <= window_us) for c in ("_true", "_used")]
        return states.withColumn("_true", true).where(live[0] != live[1]).withColumn("_state", F.col("_true")).drop("_true", "_first")

    def events_of(df: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
        return df.join(groups.select("_g").distinct(), "_g", kind)

    for _ in range(ROUNDS):
        todo = cut_lineage(changed(out))
        if todo.isEmpty():
            return out.where(F.col("_kind") == EVENT)
        again = events_of(out, todo, "left_semi").where(F.col("_kind") == EVENT).unionByName(todo.select(*out.columns))
        out = events_of(out, todo, "left_anti").unionByName(cut_lineage(walk(again)))
    todo = cut_lineage(changed(out))
    if todo.isEmpty():
        return out.where(F.col("_kind") == EVENT)
    # Segments that still change: from the first changed bucket on, one walk in order.
    first = todo.groupBy("_k", "_seg").agg(F.min_by(F.struct("_bucket", "_state"), "_bucket").alias("_from")) \
        .select(F.col("_k").alias("_fk"), F.col("_seg").alias("_fs"), F.col("_from._bucket").alias("_fb"), F.col("_from._state").alias("_enter"))
    same = F.col("_k").eqNullSafe(F.col("_fk")) & (F.col("_seg") == F.col("_fs"))
    rest = out.where(F.col("_kind") == EVENT)
    segment = F.to_json(F.struct("_k", "_seg"), {"ignoreNullFields": "false"})
    late = rest.join(first, same & (F.col("_bucket") >= F.col("_fb"))).select(*out.columns).withColumn("_g", segment)
    enter = todo.join(first, same & (F.col("_bucket") == F.col("_fb"))).withColumn("_state", F.col("_enter")) \
        .select(*out.columns).withColumn("_g", segment).withColumn("_used", F.lit(None).cast("array<bigint>"))
    early = rest.join(first, same & (F.col("_bucket") >= F.col("_fb")), "left_anti")
    return early.unionByName(walk(late.unionByName(enter), states=False))


def arrivals_in_window(events: DataFrame, key: str = "key", ts: str = "ts",
                       window_seconds: float = WINDOW_SECONDS, buckets: int | None = None) -> DataFrame:
    """Arrivals of the key within [ts - window, ts] (closed on both ends,
    ties on ts all counted).  Adds ``arrivals``.  Rows with a NULL time are
    counted among themselves, like the range window."""
    _, window_us = _check(1, window_seconds)
    t = events.withColumn("_us", event_micros(ts))
    return range_count(t, key, "_us", window_us, "arrivals", buckets).drop("_us")


def admission_summary(decided: DataFrame, key: str = "key") -> DataFrame:
    """Per key: arrivals, admitted and rejected counts (partial + final agg)."""
    return decided.groupBy(key).agg(
        F.count(F.lit(1)).alias("arrivals"),
        F.sum(F.col("admitted").cast("bigint")).alias("admitted"),
        F.sum((~F.col("admitted")).cast("bigint")).alias("rejected"))
