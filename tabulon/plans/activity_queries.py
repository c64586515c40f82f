"""Activity queries over ``events`` (W7 running best, W8 streaks) and the
catalog listing (A10) over ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import activity as A
from tabulon.operators import search as S
from tabulon.plans.registry import register
from tabulon.sources.testdata import table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


@register("activity_running_score", """
SELECT event_id, user_id, value,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS score_so_far
FROM events""")
def activity_running_score(spark, sf):
    """The score after each row is the best reached so far."""
    return A.running_max(table(spark, sf, "events")).select("event_id", "user_id", "value", "score_so_far")


@register("activity_session_best", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS session_score, min(ts) AS started
           FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, day, session_score,
       max(session_score) OVER (PARTITION BY user_id ORDER BY started, day ROWS UNBOUNDED PRECEDING) AS best_so_far
FROM s""")
def activity_session_best(spark, sf):
    """Per player and day (a session) the session score and the best
    over sessions so far."""
    return A.session_best(_events(spark, sf)).select("user_id", "day", "session_score", "best_so_far")


@register("activity_longest_streak", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island
      FROM d),
s AS (SELECT user_id, island, count(*) AS streak, min(day) AS start_day FROM i GROUP BY user_id, island),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY streak DESC, start_day) AS rn,
             count(*) OVER (PARTITION BY user_id) AS n_streaks FROM s)
SELECT user_id, streak AS longest_streak, start_day, n_streaks FROM r WHERE rn = 1""")
def activity_longest_streak(spark, sf):
    """Longest run of consecutive active days per user."""
    return A.longest_streak(_events(spark, sf))


def _part_items(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("category"), F.col("p_partkey").alias("item_pos"), F.col("p_name").alias("name"),
        F.lower("p_type").alias("profile"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("best_for"))


ITEMS_SQL = """
WITH items AS (SELECT p_brand AS category, p_partkey AS item_pos, p_name AS name, lower(p_type) AS profile,
                      'size ' || CAST(p_size AS VARCHAR) AS best_for FROM part)"""


@register("catalog_lines", ITEMS_SQL + """
SELECT category, item_pos,
       '- [' || category || '] ' || name || ': ' || profile || '. Best for: ' || best_for || '.' AS line
FROM items""")
def catalog_lines(spark, sf):
    """A10: catalog lines keyed by (category, position) (parts as items,
    brand as category)."""
    return S.catalog_lines(_part_items(spark, sf))


@register("catalog_rollup", ITEMS_SQL + """
SELECT category, count(*) AS n_items, arg_min(name, item_pos) AS first_item, min(item_pos) AS first_pos
FROM items GROUP BY category""")
def catalog_rollup(spark, sf):
    """A10 per category: item count and first item in catalog order."""
    return S.catalog_rollup(_part_items(spark, sf))
