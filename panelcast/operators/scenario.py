"""Scenario planning: A2 seasonal profile, J4 lookup, D1 future weeks, J8
scenario grid, D2 baseline projection, P15 saturation curve, D9 strategy,
D10 safe budget, D12 EBITDA.

Scenarios are a literal array exploded per series (bounded: a handful of
rows per series), so the grid needs no join; future weeks come from
``sequence``; the profile lookup is an equi-join on (series, iso week).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import iso_week, week_range_label
from ..functions.economics import AUTO, PRESETS, TABLE_ECONOMICS, Economics, economics_columns, \
    scenario_struct_array
from ..functions.exact import SUM_TYPE, xavg
from .lfl import growth_and_saturation, suggested_saturation

WEEKS_PER_MONTH = 4.34
PROFILE_COLS = ("net_sales", "spend_a", "spend_b", "orders")


def seasonal_profile(df: DataFrame) -> DataFrame:
    """A2: mean net sales, channel spends and orders per ISO week."""
    return df.groupBy("series_id", "iso_week").agg(
        *[xavg(c).alias(c) for c in PROFILE_COLS], F.count(F.lit(1)).alias("n_weeks"))


def profile_fallback(profile: DataFrame) -> DataFrame:
    """A2: the mean of the weekly means, used for weeks missing from the profile."""
    return profile.groupBy("series_id").agg(*[xavg(c).alias("fb_" + c) for c in PROFILE_COLS])


def seasonal_lookup(frame: DataFrame, profile: DataFrame, week_col: str = "iso_week") -> DataFrame:
    """Attach profile values for ``week_col``; weeks absent from the
    profile take the series fallback.  Adds ``base_<col>`` columns."""
    p = profile.select("series_id", F.col("iso_week").alias(week_col),
                       *[F.col(c).alias("p_" + c) for c in PROFILE_COLS])
    fb = profile_fallback(profile)
    out = frame.join(p, ["series_id", week_col], "left").join(fb, "series_id", "left")
    out = out.withColumns({"base_" + c: F.coalesce(F.col("p_" + c), F.col("fb_" + c)) for c in PROFILE_COLS})
    return out.drop(*["p_" + c for c in PROFILE_COLS], *["fb_" + c for c in PROFILE_COLS])


def scenario_grid(df: DataFrame, scenarios=PRESETS + (AUTO,)) -> DataFrame:
    """J8 + D1: (series x scenario x future week) with the series' last week,
    growth rate and suggested saturation (used when a scenario has none).

    Horizon = int(months * 4.34) Mondays after the series' last week.
    """
    base = growth_and_saturation(df).withColumnRenamed("saturation", "suggested_saturation")
    grid = base.select("*", F.explode(scenario_struct_array(scenarios)).alias("sc")).select(
        "series_id", "last_week", "growth_rate", "suggested_saturation", "sc.*")
    grid = grid.withColumns({
        "saturation": F.coalesce(F.col("saturation"), F.col("suggested_saturation")),
        "horizon": (F.col("months").cast("double") * WEEKS_PER_MONTH).cast("int"),
    })
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("step"))
    grid = grid.withColumn("week_start", F.date_add(F.col("last_week"), F.col("step") * 7))
    return grid.withColumn("iso_week", iso_week("week_start"))


def project_baseline(df: DataFrame, scenarios=PRESETS + (AUTO,), econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """Heuristic projection per (series, scenario, week).

    Profile x (1+growth)(1+trend) for sales and spends; spends x scale;
    sales x saturation boost (1-e^(-sat*ratio))/(1-e^(-sat)); orders = sales
    / AOV; MER and cost of sales.  The baseline is not stressed.
    """
    grid = scenario_grid(df, scenarios)
    g = seasonal_lookup(grid, seasonal_profile(df))
    trend = (F.lit(1.0) + F.col("growth_rate")) * (F.lit(1.0) + F.col("trend"))
    g = g.withColumns({
        "sales_base": F.col("base_net_sales") * trend,
        "a_base": F.col("base_spend_a") * trend,
        "b_base": F.col("base_spend_b") * trend,
    })
    g = g.withColumns({"spend_a": F.col("a_base") * F.col("scale_a"),
                       "spend_b": F.col("b_base") * F.col("scale_b")})
    total_base = F.col("a_base") + F.col("b_base")
    ratio = F.when(total_base > 0, (F.col("spend_a") + F.col("spend_b")) / total_base).otherwise(F.lit(1.0))
    sat = F.col("saturation")
    boost = F.when(sat > 0, (F.lit(1.0) - F.exp(-sat * ratio)) / (F.lit(1.0) - F.exp(-sat))).otherwise(F.lit(1.0))
    g = g.withColumn("sales", F.col("sales_base") * boost)
    g = g.withColumn("spend_total", F.col("spend_a") + F.col("spend_b"))
    aov = economics_columns(econ)["aov"]
    return g.select(
        "series_id", "scenario_id", "step", "week_start", week_range_label("week_start").alias("period_label"),
        "iso_week", "spend_a", "spend_b", "spend_total", "sales",
        (F.col("sales") / aov).alias("orders"),
        F.try_divide(F.col("sales"), F.col("spend_total")).alias("mer"),
        F.coalesce(F.try_divide(F.col("spend_total"), F.col("sales")) * 100.0, F.lit(0.0)).alias("cos"),
    )


def saturation_curve(df: DataFrame, scenarios=PRESETS + (AUTO,), points: int = 20) -> DataFrame:
    """Marginal-return curve x^sat at ``points`` evenly spaced x in [1, 4]
    per (series, scenario); 'auto' uses the series' suggested saturation."""
    sat = suggested_saturation(df).select("series_id", F.col("saturation").alias("suggested"))
    g = sat.select("series_id", "suggested", F.explode(scenario_struct_array(scenarios)).alias("sc"))
    g = g.select("series_id", F.col("sc.scenario_id").alias("scenario_id"),
                 F.coalesce(F.col("sc.saturation"), F.col("suggested")).alias("saturation"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(1.0) + F.col("i") * F.lit(3.0 / (points - 1))
    return g.select("series_id", "scenario_id", "saturation", "i", x.alias("x"),
                    F.pow(x, F.col("saturation")).alias("y"))


def strategy(kpis: DataFrame, growth: DataFrame) -> DataFrame:
    """Recommended (scale, trend, saturation) from MER vs break-even:
    > 1.3 x BE aggressive (1.25, g+.05, .92); >= BE balanced (1.10, g, .85);
    else defensive (0.85, g-.05, .80)."""
    k = kpis.select("series_id", "mer", "be_roas").join(growth.select("series_id", "growth_rate"), "series_id")
    aggressive = F.col("mer") > F.col("be_roas") * 1.3
    balanced = F.col("mer") >= F.col("be_roas")
    g = F.col("growth_rate")
    return k.select(
        "series_id", "mer", "be_roas", "growth_rate",
        F.when(aggressive, "aggressive_scaling").when(balanced, "balanced_growth")
        .otherwise("defend_optimise").alias("strategy"),
        F.when(aggressive, 1.25).when(balanced, 1.10).otherwise(0.85).alias("rec_scale"),
        F.when(aggressive, g + 0.05).when(balanced, g).otherwise(g - 0.05).alias("rec_trend"),
        F.when(aggressive, 0.92).when(balanced, 0.85).otherwise(0.80).alias("rec_saturation"),
    )


def safe_budget(projection: DataFrame, strat: DataFrame, scenario_id: str = "base", n: int = 4) -> DataFrame:
    """D10 + D12: next-``n``-week projected sales / break-even ROAS = safe
    budget; target = safe x scale / 1.1; EBITDA = (sales - safe) x scale."""
    head = (projection.filter((F.col("scenario_id") == scenario_id) & (F.col("step") <= n))
            .groupBy("series_id").agg(F.sum(F.col("sales").cast(SUM_TYPE)).cast("double").alias("next_sales")))
    s = head.join(strat.select("series_id", "be_roas", "strategy", "rec_scale"), "series_id")
    s = s.withColumn("safe_budget", F.col("next_sales") / F.col("be_roas"))
    return s.select(
        "series_id", "strategy", "rec_scale", "be_roas", "next_sales", "safe_budget",
        (F.col("safe_budget") * (F.col("rec_scale") / 1.1)).alias("target_budget"),
        (F.col("next_sales") * F.col("rec_scale") - F.col("safe_budget") * F.col("rec_scale")).alias("ebitda"),
    )
