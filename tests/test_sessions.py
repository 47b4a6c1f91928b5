"""Sessions of events against loops and Spark's own session windows; a user with most events; odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelcast.operators.sessions import sessions, weekly_sessions

START = dt.datetime(2024, 1, 1)


def plain(rows, gap):
    out = []
    for user in {u for u, _ in rows if u is not None}:
        times = sorted(t for u, t in rows if u == user and t is not None)
        for k, t in enumerate(times):
            if k == 0 or t - times[k - 1] >= dt.timedelta(minutes=gap):
                out.append([user, t, t, 0])
            out[-1][2], out[-1][3] = t, out[-1][3] + 1
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap", [1, 30, 45])
def test_against_loops(spark, gap):
    rnd = random.Random(gap)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), START + dt.timedelta(seconds=rnd.randrange(0, 400_000))) for _ in range(2500)]
    # on and next to the gap, equal times, no time
    for k, seconds in enumerate((0, gap * 60, 2 * gap * 60 - 1, 3 * gap * 60 - 1, 3 * gap * 60 - 1, 4 * gap * 60)):
        rows.append((9, START + dt.timedelta(seconds=seconds)))
    rows += [(1, None), (None, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp").repartition(7)
    got = sessions(df, gap).collect()
    assert sorted((r.user_id, r.session_start, r.session_end, r.n_events) for r in got) == plain(rows, gap)
    assert sessions(df.limit(0), gap).collect() == []


def test_against_session_windows(spark):
    events = spark.read.parquet(f"{SF001}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    own = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    want = sorted((r.user_id, r.w.start, r.last, r.n) for r in own.collect())
    assert sorted(map(tuple, sessions(events).collect())) == want


def test_a_hot_user_is_dealt_over_the_slots(spark):
    """Nine events of ten are one user's: what is ordered per user is a row a half hour, not a row an event."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("user_id"),
                                    (F.lit(START.isoformat()).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 2)).alias("ts"))
    plan = sessions(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate") or "partial_min" in plan
    hot = sessions(df).filter("user_id = -1").collect()
    assert len(hot) == 1 and hot[0].n_events == 54_000


def test_weeks_count_sessions_by_their_start(spark):
    rows = weekly_sessions(spark, SF001, "all").orderBy("week_start").collect()
    every = sessions(spark.read.parquet(f"{SF001}/events.parquet"))
    known = spark.read.parquet(f"{SF001}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    kept = every.join(known, "user_id", "left_semi")
    assert sum(r.sessions for r in rows) == kept.count() and sum(r.events for r in rows) == kept.agg(F.sum("n_events")).first()[0]
    assert all(r.week_start.weekday() == 0 and r.users <= r.sessions for r in rows)
