"""Sessions of users from raw events, and their weekly counts (the `sessions` driver of F1).

A session is a user's events with less than ``gap`` minutes between one and the
next.  Events are reduced to one row per user and time slot as long as the gap
before anything is ordered: two events of one slot are always one session, so a
slot's first and last event are all that its neighbours must see.  Partial
aggregation makes that reduction map-side, and a user with a third of all events
is dealt over the slots; the ordered pass then holds at most one row per user and
half hour, whatever the number of events.

Events without a user or a time belong to no session.  Sessions count for the
week (Monday, UTC) in which they start; users are customers, and those that are
not in ``customer`` count for no series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load, series_of_customers

GAP_MINUTES = 30


def sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(user_id, session_start, session_end, n_events); a gap of exactly ``gap_minutes`` parts two sessions."""
    gap = gap_minutes * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", at.alias("at"))
             .groupBy("user_id", F.floor(F.col("at") / gap).alias("slot"))
             .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")))
    w = Window.partitionBy("user_id").orderBy("slot")
    new = F.coalesce(F.col("first") - F.lag("last").over(w) >= gap, F.lit(True)).cast("int")
    numbered = slots.withColumn("new", new).withColumn("no", F.sum("new").over(w))
    return numbered.groupBy("user_id", "no").agg(
        F.timestamp_micros(F.min("first")).alias("session_start"), F.timestamp_micros(F.max("last")).alias("session_end"),
        F.sum("n").alias("n_events")).drop("no")


def weekly_sessions(spark: SparkSession, sf_dir: str, grain: str = "segment", gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(series_id, week_start, sessions, users, events, minutes): sessions that start in the
    week, their distinct users and events, and their mean length."""
    found = sessions(load(spark, sf_dir, "events"), gap_minutes)
    micros = F.unix_micros("session_end") - F.unix_micros("session_start")
    per_user = found.groupBy("user_id", F.date_trunc("week", "session_start").cast("date").alias("week_start")).agg(
        F.count("*").alias("sessions"), F.sum("n_events").alias("events"), F.sum(micros).alias("micros"))
    who = series_of_customers(spark, sf_dir, grain).select(F.col("custkey").alias("user_id"), "series_id")
    return per_user.join(who, "user_id").groupBy("series_id", "week_start").agg(
        F.sum("sessions").alias("sessions"), F.count("*").alias("users"), F.sum("events").alias("events"),
        (F.sum("micros").cast("double") / F.sum("sessions") / 60e6).alias("minutes"))
