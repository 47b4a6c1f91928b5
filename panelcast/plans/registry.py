"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query starts from the raw given tables (through the weekly rollup), so
its work grows with them.  Outputs round doubles to 6 decimals, the
library's precision contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exact import round_doubles
from ..operators import lfl
from ..operators.prepare import weekly_fact, weekly_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GRAIN = "segment"


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _wf(spark, sf_dir, grain=GRAIN):
    """The materialised weekly panel every analysis starts from."""
    return weekly_panel(spark, sf_dir, grain)


@register("weekly_fact")
def q_weekly_fact(spark, sf_dir):
    """The rollup from the raw tables, materialised as the shared panel."""
    return round_doubles(weekly_panel(spark, sf_dir, GRAIN))


@register("weekly_fact_nation")
def q_weekly_fact_nation(spark, sf_dir):
    return round_doubles(weekly_fact(spark, sf_dir, "nation"))


@register("lfl_growth")
def q_lfl_growth(spark, sf_dir):
    return round_doubles(lfl.lfl_growth(_wf(spark, sf_dir)))


@register("lfl_growth_all")
def q_lfl_growth_all(spark, sf_dir):
    return round_doubles(lfl.lfl_growth(_wf(spark, sf_dir, "all")))


# -- aggregates, windows, recent --------------------------------------------
from ..functions.economics import TABLE_ECONOMICS, economics_columns  # noqa: E402
from ..operators import backtest, context, monthly, recent, scenario, windows  # noqa: E402
from ..operators.lfl import trailing_growth  # noqa: E402
from . import probes  # noqa: E402


@register("annual_totals")
def q_annual_totals(spark, sf_dir):
    return round_doubles(lfl.annual_totals(_wf(spark, sf_dir)))


@register("seasonal_profile")
def q_seasonal_profile(spark, sf_dir):
    return round_doubles(scenario.seasonal_profile(_wf(spark, sf_dir)))


@register("trailing_growth")
def q_trailing_growth(spark, sf_dir):
    return round_doubles(trailing_growth(_wf(spark, sf_dir)))


@register("recent_kpis")
def q_recent_kpis(spark, sf_dir):
    return round_doubles(recent.recent_kpis(_wf(spark, sf_dir)))


@register("channel_signals")
def q_channel_signals(spark, sf_dir):
    return round_doubles(recent.channel_signals(_wf(spark, sf_dir)))


@register("lfl_elasticity")
def q_lfl_elasticity(spark, sf_dir):
    return round_doubles(lfl.lfl_elasticity(_wf(spark, sf_dir)))


@register("elasticity_summary")
def q_elasticity_summary(spark, sf_dir):
    return round_doubles(lfl.elasticity_summary(_wf(spark, sf_dir, "nation")))


@register("suggested_saturation")
def q_suggested_saturation(spark, sf_dir):
    return round_doubles(lfl.suggested_saturation(_wf(spark, sf_dir)))


@register("weekly_yoy_detail")
def q_weekly_yoy_detail(spark, sf_dir):
    return round_doubles(lfl.weekly_yoy_detail(_wf(spark, sf_dir)))


@register("yoy_health")
def q_yoy_health(spark, sf_dir):
    return round_doubles(lfl.yoy_health(_wf(spark, sf_dir)))


@register("common_weeks")
def q_common_weeks(spark, sf_dir):
    return lfl.common_weeks(_wf(spark, sf_dir))


@register("rolling_return_rate")
def q_rolling_return_rate(spark, sf_dir):
    return round_doubles(windows.rolling_return_rate(_wf(spark, sf_dir)))


@register("lag_features")
def q_lag_features(spark, sf_dir):
    from ..functions.cleaning import week_cos, week_sin
    wf = windows.origin_lags(windows.lag_features(_wf(spark, sf_dir)))
    return round_doubles(wf.select("series_id", "week_start", "iso_week", "net_sales", "lag_1", "lag_4",
                                   "o_lag_1", "o_lag_4", week_sin("iso_week").alias("week_sin"),
                                   week_cos("iso_week").alias("week_cos")))


@register("monthly_fact")
def q_monthly_fact(spark, sf_dir):
    m = monthly.monthly_ratios(monthly.monthly_fact(_wf(spark, sf_dir)))
    return round_doubles(m)


@register("health_score")
def q_health_score(spark, sf_dir):
    return round_doubles(monthly.health_score(_wf(spark, sf_dir)))


@register("break_even")
def q_break_even(spark, sf_dir):
    series = _wf(spark, sf_dir).select("series_id").distinct()
    return round_doubles(series.withColumns(economics_columns(TABLE_ECONOMICS)))


@register("strategy")
def q_strategy(spark, sf_dir):
    wf = _wf(spark, sf_dir)
    return round_doubles(scenario.strategy(recent.recent_kpis(wf), trailing_growth(wf)))


@register("project_baseline")
def q_project_baseline(spark, sf_dir):
    return round_doubles(scenario.project_baseline(_wf(spark, sf_dir)))


@register("saturation_curve")
def q_saturation_curve(spark, sf_dir):
    return round_doubles(scenario.saturation_curve(_wf(spark, sf_dir)))


@register("safe_budget")
def q_safe_budget(spark, sf_dir):
    wf = _wf(spark, sf_dir)
    strat = scenario.strategy(recent.recent_kpis(wf), trailing_growth(wf))
    return round_doubles(scenario.safe_budget(scenario.project_baseline(wf), strat))


@register("month_ledger")
def q_month_ledger(spark, sf_dir):
    return round_doubles(context.ledger(_wf(spark, sf_dir)))


@register("best_worst_month")
def q_best_worst_month(spark, sf_dir):
    return round_doubles(monthly.best_worst_month(context.ledger(_wf(spark, sf_dir))))


@register("parse_iso_week")
def q_parse_iso_week(spark, sf_dir):
    return probes.parse_iso_week_query(spark, sf_dir)


@register("clean_currency")
def q_clean_currency(spark, sf_dir):
    return round_doubles(probes.clean_currency_query(spark, sf_dir))


@register("weekly_text")
def q_weekly_text(spark, sf_dir):
    return round_doubles(probes.weekly_text_query(spark, sf_dir))


@register("weekly_csv")
def q_weekly_csv(spark, sf_dir):
    return round_doubles(probes.weekly_csv_query(spark, sf_dir))


@register("weekly_csv_rejects")
def q_weekly_csv_rejects(spark, sf_dir):
    return probes.weekly_csv_rejects_query(spark, sf_dir)


@register("weekly_sessions")
def q_weekly_sessions(spark, sf_dir):
    from ..operators.sessions import weekly_sessions
    return round_doubles(weekly_sessions(spark, sf_dir, GRAIN))


@register("weekly_text_no_orders")
def q_weekly_text_no_orders(spark, sf_dir):
    return round_doubles(probes.weekly_text_no_orders_query(spark, sf_dir))


@register("first_week_of_year")
def q_first_week_of_year(spark, sf_dir):
    x = windows.first_per_key(_wf(spark, sf_dir), ["series_id", "iso_year"])
    return round_doubles(x.select("series_id", "iso_year", "week_start", "net_sales"))


@register("origins")
def q_origins(spark, sf_dir):
    return round_doubles(backtest.origins(_wf(spark, sf_dir)))


@register("seasonal_backtest")
def q_seasonal_backtest(spark, sf_dir):
    return round_doubles(backtest.seasonal_backtest(_wf(spark, sf_dir)))


@register("weekly_fact_incremental")
def q_weekly_fact_incremental(spark, sf_dir):
    """The same fact from the states of the source files (kept per application; only changed files are read again)."""
    import hashlib

    from ..session import checkpoint_dir
    from ..sources.incremental import IncrementalPanel

    name = hashlib.sha1(f"{spark.sparkContext.applicationId} {sf_dir.rstrip('/')} {GRAIN}".encode()).hexdigest()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/panelcast-states-{name}"
    return round_doubles(IncrementalPanel(spark, sf_dir, folder, GRAIN).refresh().panel)


@register("lag_features_customer")
def q_lag_features_customer(spark, sf_dir):
    """W1 for every customer: the panel is bucketed by series, so no row moves."""
    x = windows.lag_features(weekly_panel(spark, sf_dir, "customer"))
    return round_doubles(x.select("series_id", "week_start", "net_sales", "lag_1", "lag_4"))


@register("weekly_history")
def q_weekly_history(spark, sf_dir):
    from ..sources.sinks import newest_first, weekly_history
    return newest_first(round_doubles(weekly_history(_wf(spark, sf_dir))))


@register("channel_history")
def q_channel_history(spark, sf_dir):
    from ..sources.sinks import channel_history, newest_first
    return newest_first(round_doubles(channel_history(_wf(spark, sf_dir))))


# -- forecasting and backtest (rows-only checks) ------------------------------
from ..operators import forecast as fc  # noqa: E402
from .models import backtest_result, forecast_bundle  # noqa: E402


@register("rf_forecast")
def q_rf_forecast(spark, sf_dir):
    return round_doubles(forecast_bundle(spark, sf_dir).rf)


@register("rf_importance")
def q_rf_importance(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    return round_doubles(fc.rf_importance(spark, b.model))


@register("additive_forecast")
def q_additive_forecast(spark, sf_dir):
    return round_doubles(forecast_bundle(spark, sf_dir).additive)


@register("ensemble")
def q_ensemble(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    return round_doubles(fc.ensemble(b.rf, b.additive))


@register("consensus")
def q_consensus(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    rel = backtest.reliability(backtest_result(spark, sf_dir))
    return round_doubles(fc.consensus(fc.ensemble(b.rf, b.additive), rel))


@register("timeline")
def q_timeline(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    return round_doubles(fc.timeline(b.wf, b.rf, b.additive, b.projection))


@register("allocation")
def q_allocation(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    strat = scenario.strategy(recent.recent_kpis(b.wf), trailing_growth(b.wf))
    budget = scenario.safe_budget(b.projection, strat)
    return round_doubles(fc.allocate(b.importances, recent.channel_signals(b.wf), budget))


@register("validate_weeks")
def q_validate_weeks(spark, sf_dir):
    b = forecast_bundle(spark, sf_dir)
    return round_doubles(backtest.validate_weeks(spark, b.wf, b.model))


@register("backtest")
def q_backtest(spark, sf_dir):
    return round_doubles(backtest_result(spark, sf_dir))


@register("backtest_summary")
def q_backtest_summary(spark, sf_dir):
    return round_doubles(backtest.backtest_summary(backtest_result(spark, sf_dir)))


@register("reliability")
def q_reliability(spark, sf_dir):
    return round_doubles(backtest.reliability(backtest_result(spark, sf_dir)))


@register("winner_pivot")
def q_winner_pivot(spark, sf_dir):
    return backtest.winner_matrix(backtest_result(spark, sf_dir))


@register("top_winner")
def q_top_winner(spark, sf_dir):
    return backtest.top_winner(backtest_result(spark, sf_dir))


@register("accuracy_pivot")
def q_accuracy_pivot(spark, sf_dir):
    b = backtest_result(spark, sf_dir)
    return round_doubles(backtest.backtest_month_year(b, "acc_ensemble"))


# -- scoring of a fixed prediction table, weather ----------------------------------
from . import scoring, weather_queries  # noqa: E402, F401
