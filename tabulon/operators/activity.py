"""Activity operators: running best score (W7) and longest streak of active
days (W8), both per player over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.prefix import running_max as running_max_bucketed


def session_best(events: DataFrame, player: str = "user_id", session: str = "day", score: str = "value",
                 ts: str = "ts", buckets: int | None = None) -> DataFrame:
    """A session's score is its best row so far (the max reached); the
    player's best is the running max over sessions in time order.  One
    partial + final aggregate per session, then a bucketed prefix scan per
    player over sessions (rows, not events)."""
    sessions = events.groupBy(player, session).agg(F.max(score).alias("session_score"),
                                                   F.min(ts).alias("started"))
    t = sessions.withColumn("_t", F.unix_micros(F.col("started").cast("timestamp")))
    return running_max_bucketed(t, player, ["_t", session], "_t", "session_score", "best_so_far", buckets).drop("_t")


def running_max(events: DataFrame, player: str = "user_id", score: str = "value",
                ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The score shown after each row is the max so far, ordered by
    (ts, tie).  A bucketed prefix scan: per-player time buckets scanned in
    parallel plus a carry from earlier buckets, so a player holding a third
    of all rows is not one task."""
    t = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return running_max_bucketed(t, player, ["_t", tie], "_t", score, "score_so_far").drop("_t")


def longest_streak(events: DataFrame, player: str = "user_id", day: str = "day") -> DataFrame:
    """Gaps-and-islands over distinct active days: island key =
    day - row_number(), streak = island size; per player the longest streak
    and its first day (earliest on ties)."""
    days = events.select(player, day).distinct()
    w = Window.partitionBy(player).orderBy(day)
    islands = days.withColumn("_island", F.date_sub(F.col(day), F.row_number().over(w).cast("int")))
    streaks = islands.groupBy(player, "_island").agg(F.count(F.lit(1)).alias("streak"),
                                                     F.min(day).alias("start_day"))
    return streaks.groupBy(player).agg(
        F.max(F.struct("streak", F.negative(F.datediff("start_day", F.lit("1970-01-01").cast("date")))
                       .alias("_neg"), "start_day")).alias("_best"),
        F.count(F.lit(1)).alias("n_streaks")) \
        .select(player, F.col("_best.streak").alias("longest_streak"), F.col("_best.start_day").alias("start_day"),
                "n_streaks")
