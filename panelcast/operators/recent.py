"""Recent-period operators: A6 recent KPIs with D4 promo pressure, D5 season
context and D6 margin verdict; A7/A8 channel signals with D8 flags.

One window (newest-first row number per series) tags the last four and the
four weeks before; everything else is a single conditional aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import week_range_label
from ..functions.economics import TABLE_ECONOMICS, Economics, economics_columns
from ..functions.exact import SUM_TYPE
from .windows import recency_rank


def _tagged(df: DataFrame, n: int) -> DataFrame:
    cnt = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    r = recency_rank(df).withColumn("n_rows", cnt)
    return r.withColumns({
        "is_last": F.col("rn_desc") <= n,
        "is_prev": (F.col("rn_desc") > n) & (F.col("rn_desc") <= 2 * n),
    }).filter(F.col("rn_desc") <= 2 * n)


def _sum(flag: str, c: str):
    return F.coalesce(F.sum(F.when(F.col(flag), F.col(c).cast(SUM_TYPE))).cast("double"), F.lit(0.0))


def _avg(flag: str, c: str):
    s = F.sum(F.when(F.col(flag), F.col(c).cast(SUM_TYPE))).cast("double")
    return s / F.count(F.when(F.col(flag), F.col(c)))


def _pos_ratio(num, den, default=0.0):
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def recent_kpis(df: DataFrame, econ: Economics = TABLE_ECONOMICS, n: int = 4) -> DataFrame:
    """A6 + D4 + D5 + D6: last ``n`` weeks vs the ``n`` before, per series.

    Sums of net sales, ad spend and operating profit; MER, cost of sales and
    AOV; changes are NULL when the series has fewer than 2n weeks or the base
    is zero (profit change is relative to the absolute base).
    """
    t = _tagged(df, n)
    agg = t.groupBy("series_id").agg(
        F.max("n_rows").alias("n_rows"),
        _sum("is_last", "net_sales").alias("sales"), _sum("is_prev", "net_sales").alias("p_sales"),
        _sum("is_last", "ad_spend").alias("ad_spend"), _sum("is_prev", "ad_spend").alias("p_ad_spend"),
        _sum("is_last", "op_profit").alias("profit"), _sum("is_prev", "op_profit").alias("p_profit"),
        _sum("is_last", "orders").alias("orders"), _sum("is_prev", "orders").alias("p_orders"),
        _sum("is_last", "discounts").alias("discounts"), _sum("is_prev", "discounts").alias("p_discounts"),
        F.min(F.when(F.col("is_last"), F.col("week_start"))).alias("first_week"),
        F.max(F.when(F.col("is_last"), F.col("week_start"))).alias("last_week"),
        F.max(F.when(F.col("is_last") & (F.month("week_start") == 1), 1).otherwise(0)).alias("has_jan"),
        F.max(F.when(F.col("is_last") & (F.month("week_start") == 7), 1).otherwise(0)).alias("has_jul"),
        F.max(F.when(F.col("is_last") & (F.month("week_start") == 11), 1).otherwise(0)).alias("has_nov"),
    )
    be = economics_columns(econ)["be_roas"]
    full = F.col("n_rows") >= 2 * n
    mer = _pos_ratio(F.col("sales"), F.col("ad_spend"))
    p_mer = _pos_ratio(F.col("p_sales"), F.col("p_ad_spend"))
    cos = F.when(F.col("sales") > 0, F.col("ad_spend") / F.col("sales") * 100.0).otherwise(F.lit(0.0))
    p_cos = F.when(F.col("p_sales") > 0, F.col("p_ad_spend") / F.col("p_sales") * 100.0).otherwise(F.lit(0.0))
    aov = _pos_ratio(F.col("sales"), F.col("orders"))
    p_aov = _pos_ratio(F.col("p_sales"), F.col("p_orders"))
    out = agg.withColumns({"be_roas": be, "mer": mer, "p_mer": p_mer, "cos": cos, "p_cos": p_cos,
                           "aov": aov, "p_aov": p_aov})

    def rel(c, p):
        return F.when(full & (F.col(p) > 0), (F.col(c) - F.col(p)) / F.col(p))

    disc_curr = _pos_ratio(F.abs(F.col("discounts")), F.col("sales"))
    disc_prev = F.when(full, _pos_ratio(F.abs(F.col("p_discounts")), F.col("p_sales"))).otherwise(F.lit(0.0))
    out = out.withColumns({
        "d_sales": rel("sales", "p_sales"),
        "d_ad_spend": rel("ad_spend", "p_ad_spend"),
        "d_profit": F.when(full & (F.abs(F.col("p_profit")) > 0),
                           (F.col("profit") - F.col("p_profit")) / F.abs(F.col("p_profit"))),
        "d_mer": F.when(full, F.col("mer") - F.col("p_mer")),
        "d_cos": F.when(full, F.col("cos") - F.col("p_cos")),
        "d_aov": rel("aov", "p_aov"),
        "disc_share": disc_curr, "disc_share_prev": disc_prev,
    })
    return out.select(
        "series_id", "n_rows", week_range_label("first_week").alias("period_first"),
        week_range_label("last_week").alias("period_last"), "sales", "ad_spend", "profit", "orders",
        "mer", "cos", "aov", "be_roas", (F.col("mer") - F.col("be_roas")).alias("mer_vs_be"),
        "d_sales", "d_ad_spend", "d_profit", "d_mer", "d_cos", "d_aov", "disc_share", "disc_share_prev",
        F.when(F.col("disc_share") > 0.15, "high")
        .when(F.col("disc_share") > F.col("disc_share_prev") + 0.05, "active")
        .otherwise("stable").alias("promo_pressure"),
        F.when(F.col("has_jan") == 1, "winter_sales").when(F.col("has_jul") == 1, "summer_sales")
        .when(F.col("has_nov") == 1, "black_friday").otherwise("standard").alias("season_context"),
        F.when(F.col("mer") < F.col("be_roas"), "critical")
        .when(F.col("mer") < F.col("be_roas") * 1.25, "caution")
        .otherwise("scalable").alias("margin_verdict"),
        (F.col("mer") / F.col("be_roas") - F.lit(1.0)).alias("cushion"),
    )


def channel_signals(df: DataFrame, n: int = 4) -> DataFrame:
    """A7 + A8 + D8: per channel last-``n`` spend, conversion value and ROAS;
    mean CPM/CPC now vs before and their change, mean frequency, best
    channel and gap.  With fewer than 2n weeks the prior window is the
    recent one itself (changes are then 0)."""
    t = _tagged(df, n)
    # prior window falls back to the recent one for short series
    t = t.withColumn("is_ref", F.when(F.col("n_rows") >= 2 * n, F.col("is_prev")).otherwise(F.col("is_last")))
    agg = t.groupBy("series_id").agg(
        _sum("is_last", "spend_a").alias("spend_a"), _sum("is_last", "spend_b").alias("spend_b"),
        _sum("is_last", "conv_value_a").alias("conv_value_a"),
        _sum("is_last", "conv_value_b").alias("conv_value_b"),
        _sum("is_last", "impressions_a").alias("impressions_a"),
        _avg("is_last", "cpm_b").alias("cpm_b"), _avg("is_ref", "cpm_b").alias("cpm_b_prev"),
        _avg("is_last", "frequency_b").alias("frequency_b"),
        _avg("is_last", "cpc_a").alias("cpc_a"), _avg("is_ref", "cpc_a").alias("cpc_a_prev"),
        _avg("is_last", "cpc_b").alias("cpc_b"),
    )
    roas_a = _pos_ratio(F.col("conv_value_a"), F.col("spend_a"))
    roas_b = _pos_ratio(F.col("conv_value_b"), F.col("spend_b"))
    out = agg.withColumns({"roas_a": roas_a, "roas_b": roas_b})
    out = out.withColumns({
        "cpm_change": F.when(F.col("cpm_b_prev") > 0, (F.col("cpm_b") - F.col("cpm_b_prev")) / F.col("cpm_b_prev"))
        .otherwise(F.lit(0.0)),
        "cpc_change": F.when(F.col("cpc_a_prev") > 0, (F.col("cpc_a") - F.col("cpc_a_prev")) / F.col("cpc_a_prev"))
        .otherwise(F.lit(0.0)),
        "best_channel": F.when(F.col("roas_a") > F.col("roas_b"), "a").otherwise("b"),
        "performance_gap": F.abs(F.col("roas_a") - F.col("roas_b"))
        / F.greatest(F.col("roas_a"), F.col("roas_b"), F.lit(0.01)),
    })
    return out.withColumns({
        "cpm_pressure": F.col("cpm_change") > 0.15,
        "frequency_saturated": F.col("frequency_b") > 1.4,
    })
