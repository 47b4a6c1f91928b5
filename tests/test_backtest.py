"""Seasonal arm vs a brute-force walk-forward on a small fixture; scoring."""

import datetime as dt
import random

import pytest

from panelcast.functions.cleaning import iso_week
from panelcast.operators import backtest as bt


def _brute(rows):
    """For each row: mean of earlier same-ISO-week sales, else the mean of the
    weekly means of all earlier rows."""
    out = {}
    for i, (sid, d, y) in enumerate(rows):
        prev = [r for r in rows[:i] if r[0] == sid]
        same = [r[2] for r in prev if r[1].isocalendar()[1] == d.isocalendar()[1]]
        if same:
            out[(sid, d)] = sum(same) / len(same)
        elif prev:
            by_w = {}
            for r in prev:
                by_w.setdefault(r[1].isocalendar()[1], []).append(r[2])
            means = [sum(v) / len(v) for v in by_w.values()]
            out[(sid, d)] = sum(means) / len(means)
        else:
            out[(sid, d)] = None
    return out


def test_seasonal_predictions_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for sid in ("A", "B"):
        for i in range(130):
            rows.append((sid, dt.date(2021, 1, 4) + dt.timedelta(weeks=i), float(rnd.randint(100, 999))))
    df = spark.createDataFrame(rows, "series_id string, week_start date, net_sales double").withColumn(
        "iso_week", iso_week("week_start"))
    got = {(r.series_id, r.week_start): r.pred_seasonal for r in bt.seasonal_predictions(df).collect()}
    exp = _brute(rows)
    for k, v in exp.items():
        if v is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-5)


def test_origins_window_and_min_train(spark):
    rows = [("A", dt.date(2021, 1, 4) + dt.timedelta(weeks=i), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, week_start date, net_sales double").withColumn(
        "iso_week", iso_week("week_start"))
    o = bt.origins(df).collect()
    last = rows[-1][1]
    assert all(r.n_train >= 20 and r.origin_week > dt.date(last.year - 1, last.month, last.day) for r in o)
    last_minus_12m = dt.date(last.year - 1, last.month, last.day)
    exp = [i for i, r in enumerate(rows) if r[1] > last_minus_12m and i >= 20]
    assert len(o) == len(exp) == 40


def test_score_and_winner_ties(spark):
    df = spark.createDataFrame([(100.0, 90.0, 110.0, 90.0, 100.0), (0.0, 1.0, 2.0, 3.0, 4.0)],
                               "actual double, pred_seasonal double, pred_rf double, pred_additive double, "
                               "pred_ensemble double")
    r = bt.score_models(df).collect()
    assert r[0]["winner"] == "ensemble" and r[0]["acc_ensemble"] == 1.0
    assert r[1]["winner"] == "seasonal" and r[1]["acc_seasonal"] == 0.0
    tie = spark.createDataFrame([(100.0, 90.0, 110.0, 90.0, 110.0)],
                                "actual double, pred_seasonal double, pred_rf double, pred_additive double, "
                                "pred_ensemble double")
    assert bt.score_models(tie).first()["winner"] == "seasonal"


def test_top_winner_alphabetical_tie(spark):
    df = spark.createDataFrame([("S", "rf"), ("S", "additive"), ("S", "rf"), ("S", "additive")],
                               "series_id string, winner string")
    assert bt.top_winner(df).first()["top_winner"] == "additive"


def test_training_medians_in_one_pass(spark):
    """At every origin the median of each series' rows strictly before it, series without rows at the origin included."""
    import statistics

    rnd = random.Random(9)
    rows = []
    for sid, every in (("A", 1), ("B", 2), ("C", 1)):
        for k in range(0, 60 if sid != "C" else 5, every):
            rows.append((sid, dt.date(2021, 1, 4) + dt.timedelta(weeks=k), float(rnd.randint(1, 50)) if rnd.random() < 0.7 else None,
                         float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, "series_id string, week_start date, x double, z double")
    weeks = sorted({r[1] for r in rows})[10:40]
    got = {(r.series_id, r.origin): (r.m_x, r.m_z) for r in bt.training_medians(df, weeks, ["x", "z"]).collect()}
    assert len(got) == 3 * len(weeks)
    for sid in "ABC":
        for w in weeks:
            before = [r for r in rows if r[0] == sid and r[1] < w]
            for k, value in enumerate(got[sid, w]):
                known = [r[2 + k] for r in before if r[2 + k] is not None]
                assert value == (pytest.approx(statistics.median(known)) if known else None)


def test_forest_arm_imputes_from_the_past_only(spark):
    rows = []
    for sid in ("A", "B"):
        for k in range(40):
            rows.append((sid, dt.date(2021, 1, 4) + dt.timedelta(weeks=k), 100.0 + k % 7, 10.0 + k % 3))
    df = spark.createDataFrame(rows, "series_id string, week_start date, net_sales double, spend_a double").withColumn(
        "iso_week", iso_week("week_start"))
    from pyspark.sql import functions as F

    from panelcast.operators.forecast import DRIVERS
    df = df.withColumns({"spend_b": F.lit(1.0), **{d: F.lit(None).cast("double") for d in DRIVERS}})
    o = bt.origins(df, months=1)
    out = bt.rf_backtest(spark, df, o, n_trees=3, parallelism=2).collect()
    assert len(out) == o.count() > 0 and all(100 <= r.pred_rf <= 106 for r in out)
    assert bt.rf_backtest(spark, df, o.limit(0), n_trees=3).collect() == []
