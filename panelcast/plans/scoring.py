"""Queries that score a fixed table of predictions.

Fitted models cannot be restated in SQL, but everything that judges and uses
their predictions can.  These queries feed that code with predictions that any
engine derives from the panel in the same way: the value 52 weeks back for the
seasonal arm, the last value for the forest, the value four weeks back for the
additive model, and the mean of the last two for the ensemble.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import compact_money
from ..functions.economics import AUTO, PRESETS, TABLE_ECONOMICS, join_economics, stress_multiplier
from ..functions.exact import round_doubles, sdiv, xavg, xsum
from ..operators import backtest, monthly, recent, scenario, windows
from ..operators import forecast as fc
from ..operators.lfl import trailing_growth
from ..operators.prepare import weekly_panel
from .registry import GRAIN, register

HORIZON = 26
#: Stands in for the importances of a fitted forest.
IMPORTANCES = {"spend_a": 0.6, "spend_b": 0.4}


def lagged(wf: DataFrame) -> DataFrame:
    """Weeks with all three lags as the fixed predictions."""
    x = windows.lag_features(wf, lags=(1, 4, 52))
    return x.filter(F.col("lag_52").isNotNull()).select(
        "series_id", F.col("week_start").alias("origin_week"), F.col("net_sales").alias("actual"),
        F.col("lag_52").alias("pred_seasonal"), F.col("lag_1").alias("pred_rf"), F.col("lag_4").alias("pred_additive"),
        ((F.col("lag_1") + F.col("lag_4")) / 2.0).alias("pred_ensemble"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(backtest.score_models(lagged(weekly_panel(spark, sf_dir, GRAIN))))


def arms(wf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest weeks as forecasts of two scenarios, one of them stressed."""
    x = windows.recency_rank(windows.lag_features(wf)).filter(F.col("rn_desc") <= HORIZON)
    stress = {s.scenario_id: stress_multiplier(F.lit(float(s.cpm_stress_pct)), F.lit(float(s.cr_stress_pct)))
              for s in PRESETS if s.scenario_id in ("base", "stress")}
    x = x.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("scenario_id"), v.alias("m")) for k, v in stress.items()])))
    key = ("series_id", F.col("s.scenario_id").alias("scenario_id"), "week_start")
    rf = x.select(*key, (F.lit(HORIZON + 1) - F.col("rn_desc")).alias("step"), (F.col("lag_1") * F.col("s.m")).alias("pred_rf"),
                  (F.col("spend_a") + F.col("spend_b")).alias("spend_total"))
    yhat = F.col("lag_4") * F.col("s.m")
    additive = x.select(*key, F.lit("forecast").alias("kind"), yhat.alias("yhat"), (yhat * 0.5).alias("yhat_lower"),
                        (yhat * 1.5).alias("yhat_upper"))
    return round_doubles(rf), round_doubles(additive)


@register("scored_weeks")
def q_scored_weeks(spark, sf_dir):
    x = scored(spark, sf_dir)
    return x.withColumn("band", backtest.accuracy_band("acc_ensemble"))


@register("scored_summary")
def q_scored_summary(spark, sf_dir):
    return round_doubles(backtest.backtest_summary(scored(spark, sf_dir)))


@register("scored_reliability")
def q_scored_reliability(spark, sf_dir):
    return round_doubles(backtest.reliability(scored(spark, sf_dir)))


@register("scored_month_year")
def q_scored_month_year(spark, sf_dir):
    return round_doubles(backtest.backtest_month_year(scored(spark, sf_dir), "acc_ensemble"))


@register("scored_accuracy_matrix")
def q_scored_accuracy_matrix(spark, sf_dir):
    return round_doubles(backtest.accuracy_matrix(scored(spark, sf_dir)))


@register("scored_winner_matrix")
def q_scored_winner_matrix(spark, sf_dir):
    return backtest.winner_matrix(scored(spark, sf_dir))


@register("scored_top_winner")
def q_scored_top_winner(spark, sf_dir):
    return backtest.top_winner(scored(spark, sf_dir))


@register("scored_ensemble")
def q_scored_ensemble(spark, sf_dir):
    rf, additive = arms(weekly_panel(spark, sf_dir, GRAIN))
    return round_doubles(fc.ensemble(rf, additive))


@register("scored_consensus")
def q_scored_consensus(spark, sf_dir):
    rf, additive = arms(weekly_panel(spark, sf_dir, GRAIN))
    rel = round_doubles(backtest.reliability(scored(spark, sf_dir)))
    return round_doubles(fc.consensus(round_doubles(fc.ensemble(rf, additive)), rel))


@register("scored_allocation")
def q_scored_allocation(spark, sf_dir):
    wf = weekly_panel(spark, sf_dir, GRAIN)
    budget = scenario.safe_budget(scenario.project_baseline(wf), scenario.strategy(recent.recent_kpis(wf), trailing_growth(wf)))
    return round_doubles(fc.allocate(IMPORTANCES, recent.channel_signals(wf), budget))


def overrides(wf: DataFrame) -> DataFrame:
    """An override for every tenth ISO week: half the spend of channel a, the same of b, half as much again in sales."""
    return wf.filter(F.col("iso_week") % 10 == 0).select(
        "series_id", "week_start", (F.col("spend_a") * 0.5).alias("spend_a"), F.lit(None).cast("double").alias("spend_b"),
        (F.col("net_sales") * 1.5).alias("actual"))


@register("scored_validation")
def q_scored_validation(spark, sf_dir):
    """F11 + F12: the weeks that have both lags, with overrides, judged."""
    wf = weekly_panel(spark, sf_dir, GRAIN)
    x = backtest.overridden(windows.lag_features(wf).filter(F.col("lag_4").isNotNull()), overrides(wf))
    x = x.select("series_id", "week_start", "actual", "spend_a", "spend_b", "cpc_a", F.col("lag_1").alias("pred_rf"),
                 F.col("lag_4").alias("pred_additive"))
    return round_doubles(backtest.judge_weeks(x))


@register("scored_timeline")
def q_scored_timeline(spark, sf_dir):
    """history, projection and both forecasts of the base scenario in long form, values as compact money (P14) too."""
    wf = weekly_panel(spark, sf_dir, GRAIN)
    rf, additive = arms(wf)
    x = round_doubles(fc.timeline(wf, rf, additive, scenario.project_baseline(wf)))
    return x.withColumn("label", compact_money("value"))


@register("rf_features")
def q_rf_features(spark, sf_dir):
    x = fc.rf_features(weekly_panel(spark, sf_dir, GRAIN))
    return round_doubles(x.select("series_id", "week_start", *fc.BASE_FEATURES, *fc.DRIVERS))


@register("driver_means")
def q_driver_means(spark, sf_dir):
    return round_doubles(fc.driver_means(weekly_panel(spark, sf_dir, GRAIN), 4))


@register("stressed_sales")
def q_stressed_sales(spark, sf_dir):
    """Annual sales of each series under every scenario's stress multiplier."""
    from ..operators import lfl

    x = lfl.annual_totals(weekly_panel(spark, sf_dir, GRAIN)).withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(s.scenario_id).alias("scenario_id"), F.lit(float(s.cpm_stress_pct)).alias("cpm"),
                 F.lit(float(s.cr_stress_pct)).alias("cr")) for s in (*PRESETS, AUTO)])))
    stress = stress_multiplier(F.col("s.cpm"), F.col("s.cr"))
    return round_doubles(x.select("series_id", "iso_year", "s.scenario_id", stress.alias("stress"),
                                  (F.col("net_sales") * stress).alias("stressed_sales")))


def series_economics(wf: DataFrame) -> DataFrame:
    """Economics of each series as its own panel shows them: mean order value,
    share of returns and of returning customers; the rest are the defaults."""
    e = TABLE_ECONOMICS
    rate = lambda a, b: F.round(F.coalesce(sdiv(a, b), F.lit(0.0)), 6)
    return wf.groupBy("series_id").agg(
        rate(xsum("total_sales"), xsum("orders")).alias("aov"), F.lit(e.vat_pct).alias("vat_pct"),
        rate(xsum(F.abs(F.col("returns"))) * 50.0, xsum("total_sales")).alias("return_pct"), F.lit(e.margin_pct).alias("margin_pct"),
        F.lit(e.fulfilment).alias("fulfilment"), F.round(xavg("returning_rate_pct"), 6).alias("returning_pct"),
        F.lit(e.repeat_rate).alias("repeat_rate"))


@register("series_break_even")
def q_series_break_even(spark, sf_dir):
    econ = series_economics(weekly_panel(spark, sf_dir, GRAIN))
    return round_doubles(join_economics(econ.select("series_id"), econ))


@register("series_health_score")
def q_series_health_score(spark, sf_dir):
    wf = weekly_panel(spark, sf_dir, GRAIN)
    return round_doubles(monthly.health_score(wf, series_economics(wf)))
