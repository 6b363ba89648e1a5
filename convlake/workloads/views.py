"""Derived inputs shared by the queries, each with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.plans import slices as S

# --- turn times: 50 ms per character, 300 ms between turns --------------------------------

TURN_TIMES = """
turn_times AS (
  SELECT conv_id, turn, role, text,
         (CAST(coalesce(sum(length(text) * 50) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 300 * turn) AS start_ms,
         length(text) * 50 AS dur_ms
  FROM conversations)
"""

OVERLAP_TIMES = TURN_TIMES + """,
overlap_times AS (
  SELECT conv_id, turn, role, text,
         greatest(start_ms - CASE WHEN (conv_id + turn) % 3 = 0 THEN 1000 ELSE 0 END, 0) AS start_ms,
         start_ms + dur_ms AS end_ms
  FROM turn_times)
"""

FRAMES = """
ev AS (SELECT *, epoch_us(ts) AS ts_us FROM events),
frames AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS idx,
         least(value / 200, 1.0) AS prob, event_type,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 3
              WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 2 END AS label
  FROM ev)
"""

# label ids follow the order of the turn tags
TAGS = {"<system_end>": 0, "<user_end>": 1, "system": 2, "user": 3}


def turn_times(t) -> DataFrame:
    c = t.conversations.withColumn("dur_ms", F.length("text").cast("long") * 50)
    c = S.scan(c, ["conv_id"], ["turn"], S.by_index("turn"), [S.RunSum("_before", F.col("dur_ms"), inclusive=False)])
    return c.select("conv_id", "turn", "role", "text", (F.col("_before") + 300 * F.col("turn")).alias("start_ms"), "dur_ms")


def overlap_times(t) -> DataFrame:
    v = turn_times(t)
    back = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 1000).otherwise(0)
    return v.select(
        "conv_id", "turn", "role", "text",
        F.greatest(F.col("start_ms") - back, F.lit(0)).cast("long").alias("start_ms"),
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
    )


def events(t) -> DataFrame:
    """Events with a time-zone free microsecond column (the table holds TIMESTAMP_NTZ)."""
    return t.events.withColumn("ts_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))


def frames(t) -> DataFrame:
    """Each user's events as scored, labelled frames."""
    e = events(t).select("user_id", "ts_us", "event_id", "value", "event_type")
    e = S.row_index(e, ["user_id"], ["ts_us", "event_id"], S.by_micros("ts_us"), "idx")
    label = (
        F.when(F.col("event_type").isin("click", "view", "purchase"), 3)
        .when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "signup", 2)
    )
    return e.select("user_id", "idx", F.least(F.col("value") / 200, F.lit(1.0)).alias("prob"), "event_type", label.alias("label"))
