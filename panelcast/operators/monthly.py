"""Monthly fact (A4), monthly ratios (A5), seasonality (W5) and the monthly
health score (D7) with tags and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.economics import TABLE_ECONOMICS, Economics, with_economics
from ..functions.exact import sdiv, xavg, xsum
from .windows import last_periods, share_of_mean

MONTH_SUMS = ("ad_spend", "net_sales", "orders", "returns", "discounts", "spend_a", "spend_b",
              "conv_value_a", "conv_value_b", "gross_sales", "op_profit")
MONTH_MEANS = ("returning_rate_pct", "frequency_b", "cpm_b", "cpc_a", "cpc_b")


def monthly_fact(df: DataFrame) -> DataFrame:
    """A4: month sums and means per series; month = month of the week start."""
    m = df.withColumn("month", F.trunc("week_start", "MM"))
    aggs = [F.coalesce(xsum(c), F.lit(0.0)).alias(c) for c in MONTH_SUMS]
    aggs += [xavg(c).alias(c) for c in MONTH_MEANS]
    return m.groupBy("series_id", "month").agg(*aggs, F.count(F.lit(1)).alias("n_weeks"))


def monthly_ratios(m: DataFrame, ltv_cap: float = 0.90) -> DataFrame:
    """A5 + W5: MER, AOV, CPA, LTV = AOV/(1-min(ret, cap)), LTV/CPA, discount
    rate on gross sales, channel ROAS and seasonality (sales / series mean)."""
    out = m.withColumns({
        "mer": sdiv("net_sales", "ad_spend"),
        "aov": sdiv("net_sales", "orders"),
        "cpa": sdiv("ad_spend", "orders"),
        "ret_rate": F.col("returning_rate_pct") / 100.0,
    })
    out = out.withColumn("ltv", F.col("aov") / (F.lit(1.0) - F.least(F.col("ret_rate"), F.lit(ltv_cap))))
    return share_of_mean(out, "net_sales", "seasonality").withColumns({
        "ltv_cpa": sdiv("ltv", "cpa"),
        "discount_rate": sdiv(F.abs(F.col("discounts")), F.col("gross_sales")) * 100.0,
        "roas_a": sdiv("conv_value_a", "spend_a"),
        "roas_b": sdiv("conv_value_b", "spend_b"),
    })


def health_score(df: DataFrame, econ: Economics | DataFrame = TABLE_ECONOMICS, n_months: int = 12) -> DataFrame:
    """Score of the ``n_months`` newest months per series.

    50 points; +15 if MER >= break-even ROAS else -15; +20 if LTV/CPA > 3.5,
    -10 if < 2; -10 if the discount rate > 15 %.  Displayed score is capped
    at 100; band high >= 70, medium >= 50, else low.  Tags and alerts are
    comma-separated codes (numbers are in their own columns).
    """
    m = monthly_ratios(monthly_fact(df))
    m = last_periods(m, "month", n_months).withColumnRenamed("aov", "month_aov")
    m = with_economics(m, econ, keep=("be_roas",)).withColumnRenamed("month_aov", "aov")
    mer_ok = F.coalesce(F.col("mer") >= F.col("be_roas"), F.lit(False))
    ltv_hi = F.coalesce(F.col("ltv_cpa") > 3.5, F.lit(False))
    ltv_lo = F.coalesce(F.col("ltv_cpa") < 2.0, F.lit(False))
    disc_hi = F.coalesce(F.col("discount_rate") > 15, F.lit(False))
    a_top = F.coalesce(F.col("roas_a") > F.col("roas_b"), F.lit(False))
    score = (F.lit(50) + F.when(mer_ok, 15).otherwise(-15)
             + F.when(ltv_hi, 20).when(ltv_lo, -10).otherwise(0)
             + F.when(disc_hi, -10).otherwise(0))
    tags = F.array_compact(F.array(
        F.when(mer_ok, F.lit("mer_pro")), F.when(ltv_hi, F.lit("high_ltv")),
        F.when(a_top, F.lit("top_a")).otherwise(F.lit("top_b"))))
    alerts = F.array_compact(F.array(
        F.when(~mer_ok, F.lit("low_margin")), F.when(ltv_lo, F.lit("low_retention")),
        F.when(disc_hi, F.lit("excess_discounts"))))
    out = m.withColumns({"raw_score": score})
    return out.select(
        "series_id", "month", "net_sales", "ad_spend", "orders", "mer", "aov", "cpa", "ltv", "ltv_cpa",
        "discount_rate", "roas_a", "roas_b", "seasonality",
        F.least(F.col("raw_score"), F.lit(100)).alias("score"),
        F.when(F.col("raw_score") >= 70, "high").when(F.col("raw_score") >= 50, "medium")
        .otherwise("low").alias("band"),
        F.when(F.col("seasonality") > 1.2, "high").when(F.col("seasonality") < 0.8, "low")
        .otherwise("standard").alias("season"),
        F.when(a_top, "a").otherwise("b").alias("best_channel"),
        F.array_join(tags, ",").alias("tags"),
        F.array_join(alerts, ",").alias("alerts"),
    )


def best_worst_month(ledger: DataFrame) -> DataFrame:
    """Month with the highest and the lowest MER per series; ties go to
    the earliest month.  Months without a MER are ignored."""
    x = ledger.filter(F.col("mer").isNotNull())
    return x.groupBy("series_id").agg(
        F.min_by("month", F.struct(-F.col("mer"), F.col("month"))).alias("best_month"),
        F.max("mer").alias("best_mer"),
        F.min_by("month", F.struct(F.col("mer"), F.col("month"))).alias("worst_month"),
        F.min("mer").alias("worst_mer"),
    )
