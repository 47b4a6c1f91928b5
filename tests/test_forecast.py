"""Forecast invariants (rows-only operators) at sf0.001."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelcast.operators import forecast as fc
from panelcast.sources.calendar import HOLIDAY_COLS


def test_additive_recovers_noiseless_trend_and_regressor():
    n = 200
    t_days = np.arange(n) * 7.0 + 10000
    spend = np.sin(np.arange(n) / 5.0) * 10 + 50
    y = 1000 + 2.0 * np.arange(n) + 30.0 * spend
    cols = {f"f{s}{k}": np.zeros(n) for k in range(1, fc.FOURIER_ORDER + 1) for s in ("s", "c")}
    base = pd.DataFrame({"t_days": t_days, "y": y, **{c: 0.0 for c in HOLIDAY_COLS}, "spend_a": spend, "spend_b": 0.0,
                         **{d: 0.0 for d in fc.DRIVERS}, **cols})
    train, test = base.iloc[:150], base.iloc[150:]
    yhat, sigma, fitted = fc._fit_predict(train, test)
    assert np.max(np.abs(fitted - train["y"].to_numpy()) / train["y"].to_numpy()) < 0.01
    assert np.max(np.abs(yhat - test["y"].to_numpy()) / test["y"].to_numpy()) < 0.05


@pytest.fixture(scope="module")
def bundle(spark):
    from panelcast.plans.models import forecast_bundle
    return forecast_bundle(spark, SF001, n_trees=20)


def test_rf_forecast_horizon(bundle):
    rows = bundle.rf.groupBy("series_id", "scenario_id").agg(F.count("*").alias("n"),
                                                             F.min("step").alias("lo"), F.max("step").alias("hi"))
    for r in rows.collect():
        assert (r.n, r.lo, r.hi) == (26, 1, 26)
    assert bundle.rf.filter(F.col("pred_rf").isNull()).count() == 0


def test_stress_scales_first_step(bundle):
    r = {x.scenario_id: x.pred_rf for x in bundle.rf.filter("step = 1 AND series_id = 'BUILDING'").collect()}
    assert r["stress"] == pytest.approx(r["base"] * (1 / 1.2) * 0.9)


def test_importances_sum_to_one(spark, bundle):
    imp = fc.rf_importance(spark, bundle.model)
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_ensemble_between_arms(bundle):
    e = fc.ensemble(bundle.rf, bundle.additive)
    bad = e.filter((F.col("pred_ensemble") < F.least("pred_rf", "pred_additive") - 1e-6)
                   | (F.col("pred_ensemble") > F.greatest("pred_rf", "pred_additive") + 1e-6))
    assert e.count() > 0 and bad.count() == 0


def test_additive_interval_contains_point(bundle):
    a = bundle.additive
    assert a.filter((F.col("yhat_lower") > F.col("yhat")) | (F.col("yhat_upper") < F.col("yhat"))).count() == 0
    assert a.filter("kind = 'forecast'").count() == 5 * 5 * 26


def test_validate_weeks_overrides(spark, bundle):
    from panelcast.operators import backtest as bt

    wk = bundle.wf.filter("series_id = 'BUILDING'").orderBy(F.desc("week_start")).first()
    over = spark.createDataFrame([("BUILDING", wk.week_start, wk.spend_a, wk.spend_b, wk.net_sales * 3.0)],
                                 "series_id string, week_start date, spend_a double, spend_b double, actual double")
    base = bt.validate_weeks(spark, bundle.wf, bundle.model).filter(
        (F.col("series_id") == "BUILDING") & (F.col("week_start") == wk.week_start)).first()
    moved = bt.validate_weeks(spark, bundle.wf, bundle.model, over).filter(
        (F.col("series_id") == "BUILDING") & (F.col("week_start") == wk.week_start)).first()
    assert moved.actual == pytest.approx(wk.net_sales * 3.0)
    assert moved.pred_rf == pytest.approx(base.pred_rf)          # same spends -> same forest input
    assert moved.accuracy_pct < base.accuracy_pct
    assert moved.tier == "deviation" and moved.flag_unseen_factors is True


def test_fold_over_trees_is_the_fitted_forest(spark, bundle):
    """The tree walk as a Column gives what MLlib predicts, missing values included."""
    feats = bundle.feats.withColumn("cpc_a", F.when(F.col("iso_week") % 5 != 0, F.col("cpc_a")))
    names = fc.BASE_FEATURES + fc.DRIVERS
    depth = max(t.depth for t in bundle.model.stages[-1].trees)
    v = F.array(F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in names]))
    own = F.aggregate(v, F.lit(0.0), lambda _, x: fc.forest_value(F.col("trees"), x, depth))
    rows = bundle.model.transform(feats).withColumn("trees", fc.forest(spark, bundle.model)).withColumn("own", own).select("prediction", "own").collect()
    assert len(rows) > 500 and max(abs(r.prediction - r.own) / abs(r.prediction) for r in rows) < 1e-12


def test_forecast_is_the_recursion_step_by_step(spark, bundle):
    """One series and scenario, predicted week by week with the model itself."""
    import math

    got = {r.step: r.pred_rf for r in bundle.rf.filter("series_id = 'BUILDING' and scenario_id = 'stress'").collect()}
    path = bundle.projection.filter("series_id = 'BUILDING' and scenario_id = 'stress'").orderBy("step").collect()
    last = [r.net_sales for r in bundle.feats.filter("series_id = 'BUILDING'").orderBy(F.desc("week_start")).limit(4).collect()]
    means = fc.driver_means(bundle.feats, 4).filter("series_id = 'BUILDING'").first()
    stress = 1 / 1.2 * 0.9
    for r in path[:6]:
        row = {"week_sin": math.sin(2 * math.pi * r.iso_week / 53), "week_cos": math.cos(2 * math.pi * r.iso_week / 53),
               "spend_a": r.spend_a, "spend_b": r.spend_b, "lag_1": last[0], "lag_4": last[3], **{d: means[d] for d in fc.DRIVERS}}
        x = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
        pred = bundle.model.transform(x).first().prediction * stress
        assert got[r.step] == pytest.approx(pred, rel=1e-9)
        last = [pred, *last[:3]]


def test_forecast_is_one_stage_of_rows(spark, bundle):
    """The plan does not grow with the horizon: no join, write or broadcast per step."""
    plan = fc.rf_forecast(spark, bundle.model, bundle.feats, bundle.projection)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 12 and "transform" not in plan.lower().replace("transformwith", "")


def additive_frame(y):
    t = np.arange(len(y)) * 7.0 + 10000
    waves = {f"f{s}{k}": f(2 * np.pi * k / 365.25 * t) for k in range(1, fc.FOURIER_ORDER + 1) for s, f in (("s", np.sin), ("c", np.cos))}
    return pd.DataFrame({"t_days": t, "y": y, **{c: 0.0 for c in HOLIDAY_COLS}, "spend_a": 0.0, "spend_b": 0.0,
                         **{d: 0.0 for d in fc.DRIVERS}, **waves})


def test_one_break_gets_one_changepoint():
    n = 260
    at = fc.AdditiveFit(additive_frame(np.ones(n))).points[12]
    t = np.arange(n) / (n - 1)
    y = 500 + 200 * t + 900 * np.maximum(t - at, 0)
    model = fc.AdditiveFit(additive_frame(y))
    change = np.abs(model.changes * model.scale)
    assert change.argmax() == 12 and change[12] == pytest.approx(900, rel=0.01) and np.delete(change, 12).sum() < 1
    straight = fc.AdditiveFit(additive_frame(500 + 200 * t))
    assert (straight.changes == 0).all()
    # with noise the break stays where it is, within its neighbours
    noisy = fc.AdditiveFit(additive_frame(y + np.random.default_rng(1).normal(size=n) * 20))
    change = noisy.changes * noisy.scale
    assert change[11:14].sum() == pytest.approx(900, rel=0.1) and np.abs(np.delete(change, [11, 12, 13])).sum() < 200


def test_sparse_solution_meets_its_conditions():
    """Optimality of the absolute-value penalty: the pull on a zero stays within the weight, on others it is the weight."""
    rng = np.random.default_rng(3)
    for size in (1, 5, 25):
        for _ in range(20):
            a = rng.normal(size=(size + 4, size))
            a[:, size // 2] = a[:, 0]  # two alike
            g, c, weight = a.T @ a, rng.normal(size=size) * 4, abs(rng.normal())
            c[size // 2] = c[0]
            x = fc._sparse_solution(g, c, weight)
            pull = c - g @ x
            assert (np.abs(pull[x == 0]) <= weight + 1e-6).all()
            assert np.abs(pull[x != 0] - weight * np.sign(x[x != 0])).max(initial=0) < 1e-6


def test_interval_widens_and_covers():
    """80 % intervals, 26 weeks ahead, of series whose trend keeps changing as in their history."""
    rng, hit, total = np.random.default_rng(11), 0, 0
    n, ahead = 208, 26
    for _ in range(60):
        t = np.arange(n + ahead) / (n - 1)
        rate = np.zeros(n + ahead)
        for _ in range(rng.poisson(25 * t[-1])):
            rate += rng.laplace(scale=0.6) * (t >= rng.uniform(0, t[-1]))
        y = 1000 + 200 * np.cumsum(rate) / (n - 1) + rng.normal(size=n + ahead) * 10
        frame = additive_frame(y)
        model = fc.AdditiveFit(frame.iloc[:n])
        new = frame.iloc[n:]
        width = model.interval(new)
        assert (np.diff(width) >= 0).all()
        hit += (np.abs(model.predict(new) - new["y"].to_numpy()) <= width).sum()
        total += ahead
    assert width[-1] > width[0] and 0.6 < hit / total < 0.95
