"""Like-for-like year comparisons: W6 year pairs, J1 common weeks, O4, L1-L6,
J3 weekly detail, A9 year metrics, A18 elasticity average.

All comparisons are on *common ISO weeks*: a pair (year, prev_year) of
adjacent available years per series keeps only weeks present in both.  The
plan never joins the fact to itself: :func:`lfl_rows` finds the common weeks
and puts both years' values side by side with two window passes, and every
comparison is then one aggregation per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import SUM_TYPE, sdiv, xsum

PAIR = ("series_id", "year", "prev_year")


def year_pairs(df: DataFrame) -> DataFrame:
    """Adjacent available ISO years per series, newest first."""
    years = df.select("series_id", F.col("iso_year").alias("year")).distinct()
    w = Window.partitionBy("series_id").orderBy(F.desc("year"))
    return (years.withColumn("prev_year", F.lead("year").over(w))
            .filter(F.col("prev_year").isNotNull()))


def lfl_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """J1 without joins: one row per common (series, year, week) with the
    current and previous-year values side by side (``<col>_curr``,
    ``<col>_prev``).

    The previous *available* year of each row is a RANGE-frame max over the
    series' years; the previous occurrence of the same ISO week is a ``lag``
    over (series, week).  A week is common to the pair exactly when the two
    agree.  Two window passes, no self-join; a (series, week) partition
    holds one row per year.
    """
    w_week = Window.partitionBy("series_id", "iso_week").orderBy("iso_year")
    w_years = Window.partitionBy("series_id").orderBy("iso_year").rangeBetween(Window.unboundedPreceding, -1)
    x = df.select("series_id", "iso_year", "iso_week", *cols,
                  F.lag("iso_year").over(w_week).alias("__week_prev_year"),
                  *[F.lag(c).over(w_week).alias(c + "__lag") for c in cols])
    x = x.withColumn("prev_year", F.max("iso_year").over(w_years))
    x = x.filter(F.col("__week_prev_year") == F.col("prev_year"))
    return x.select("series_id", F.col("iso_year").alias("year"), "prev_year", "iso_week",
                    *[F.col(c).alias(c + "_curr") for c in cols],
                    *[F.col(c + "__lag").alias(c + "_prev") for c in cols])


def _xs(c: str):
    return F.sum(F.col(c).cast(SUM_TYPE)).cast("double")


def annual_totals(df: DataFrame) -> DataFrame:
    """A1: spend and sales per ISO year, first week of the year in the data."""
    return df.groupBy("series_id", "iso_year").agg(
        F.coalesce(xsum("ad_spend"), F.lit(0.0)).alias("ad_spend"),
        F.coalesce(xsum("net_sales"), F.lit(0.0)).alias("net_sales"),
        F.min("week_start").alias("first_week"),
        F.count(F.lit(1)).alias("n_weeks"),
    )


def lfl_growth(df: DataFrame, partial_weeks: int = 48) -> DataFrame:
    """L1: growth of net sales on common weeks for each adjacent year pair.

    ``growth`` is NULL when the base is not positive.  ``is_partial`` marks
    pairs with fewer than ``partial_weeks`` common weeks.  A pair without any
    common week falls back to whole-year totals (``basis='whole_year'``) and
    is kept only when the previous year's total is positive.
    """
    common = lfl_rows(df, ["net_sales"]).groupBy(*PAIR).agg(
        F.coalesce(_xs("net_sales_curr"), F.lit(0.0)).alias("sales_curr"),
        F.coalesce(_xs("net_sales_prev"), F.lit(0.0)).alias("sales_prev"),
        F.count(F.lit(1)).cast("int").alias("n_common_weeks"),
    )
    # adjacent available years with both whole-year totals: one window pass
    # over the (series, year) totals instead of pair / total joins
    w = Window.partitionBy("series_id").orderBy("iso_year")
    annual = annual_totals(df).select(
        "series_id", F.col("iso_year").alias("year"), F.col("net_sales").alias("yr_curr"),
        F.lag("iso_year").over(w).alias("prev_year"), F.lag("net_sales").over(w).alias("yr_prev"))
    out = annual.filter(F.col("prev_year").isNotNull()).join(common, list(PAIR), "left")
    has_common = F.col("n_common_weeks").isNotNull()
    s_cur = F.when(has_common, F.col("sales_curr")).otherwise(F.col("yr_curr"))
    s_prev = F.when(has_common, F.col("sales_prev")).otherwise(F.col("yr_prev"))
    out = out.select(
        "series_id", "year", "prev_year",
        F.coalesce(F.col("n_common_weeks"), F.lit(0)).alias("n_common_weeks"),
        F.when(has_common, F.lit("lfl")).otherwise(F.lit("whole_year")).alias("basis"),
        s_cur.alias("sales_curr"), s_prev.alias("sales_prev"),
    )
    out = out.filter(F.col("basis").eqNullSafe("lfl") | (F.col("sales_prev") > 0))
    return out.select(
        "series_id", "year", "prev_year", "basis", "n_common_weeks", "sales_curr", "sales_prev",
        F.when(F.col("sales_prev") > 0,
               (F.col("sales_curr") - F.col("sales_prev")) / F.col("sales_prev")).alias("growth"),
        (F.col("basis").eqNullSafe("lfl") & (F.col("n_common_weeks") < partial_weeks)).alias("is_partial"),
    )


def lfl_elasticity(df: DataFrame) -> DataFrame:
    """L2: spend and sales change on common weeks and their ratio.

    Elasticity is 0 unless the spend change exceeds 1 %; pairs without a
    common week are omitted.
    """
    agg = lfl_rows(df, ["ad_spend", "net_sales"]).groupBy(*PAIR).agg(
        F.coalesce(_xs("ad_spend_curr"), F.lit(0.0)).alias("spend_curr"),
        F.coalesce(_xs("ad_spend_prev"), F.lit(0.0)).alias("spend_prev"),
        F.coalesce(_xs("net_sales_curr"), F.lit(0.0)).alias("sales_curr"),
        F.coalesce(_xs("net_sales_prev"), F.lit(0.0)).alias("sales_prev"),
        F.count(F.lit(1)).cast("int").alias("n_common_weeks"),
    )
    d_spend = F.when(F.col("spend_prev") > 0,
                     (F.col("spend_curr") - F.col("spend_prev")) / F.col("spend_prev")).otherwise(F.lit(0.0))
    d_rev = F.when(F.col("sales_prev") > 0,
                   (F.col("sales_curr") - F.col("sales_prev")) / F.col("sales_prev")).otherwise(F.lit(0.0))
    out = agg.withColumns({"d_spend": d_spend, "d_rev": d_rev})
    return out.select(
        *PAIR, "n_common_weeks", "spend_curr", "spend_prev", "sales_curr", "sales_prev",
        (F.col("d_spend") * 100.0).alias("delta_spend_pct"),
        (F.col("d_rev") * 100.0).alias("delta_sales_pct"),
        F.when(F.abs(F.col("d_spend")) > 0.01, F.col("d_rev") / F.col("d_spend"))
        .otherwise(F.lit(0.0)).alias("elasticity"),
    )


def elasticity_verdict(avg_elasticity) -> F.Column:
    """L4: > 0.95 scalable, > 0.75 standard, else saturated; NULL stays NULL."""
    e = F.col(avg_elasticity) if isinstance(avg_elasticity, str) else avg_elasticity
    return (F.when(e.isNull(), F.lit(None).cast("string"))
            .when(e > 0.95, "scalable").when(e > 0.75, "standard").otherwise("saturated"))


def elasticity_summary(df: DataFrame) -> DataFrame:
    """A18 + L4: mean of positive pair elasticities per series and a verdict."""
    e = lfl_elasticity(df)
    pos = F.when(F.col("elasticity") > 0, F.col("elasticity").cast(SUM_TYPE))
    out = e.groupBy("series_id").agg(
        (F.sum(pos).cast("double") / F.count(pos)).alias("avg_elasticity"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    return out.withColumn("verdict", elasticity_verdict("avg_elasticity"))


def suggested_saturation(df: DataFrame, default: float = 0.85) -> DataFrame:
    """L3: whole-year sales change over spend change for the last two years,
    clipped to [0.6, 1.0] when spend grew more than 5 %, else ``default``."""
    w = Window.partitionBy("series_id").orderBy(F.desc("iso_year"))
    last2 = annual_totals(df).withColumn("rn", F.row_number().over(w)).groupBy("series_id").agg(*_last_two_years())
    return _saturation(last2, default).select("series_id", "last_year", "prev_year", "d_spend", "d_rev", "saturation")


def _last_two_years() -> list[Column]:
    """Years, spends and sales of a series' last two years, from its years ranked newest first."""
    pick = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    return [pick(1, "iso_year").alias("last_year"), pick(2, "iso_year").alias("prev_year"),
            pick(1, "ad_spend").alias("spend_last"), pick(2, "ad_spend").alias("spend_prev"),
            pick(1, "net_sales").alias("sales_last"), pick(2, "net_sales").alias("sales_prev")]


def _saturation(last2: DataFrame, default: float) -> DataFrame:
    d_spend = sdiv(F.col("spend_last") - F.col("spend_prev"), F.col("spend_prev"))
    d_rev = sdiv(F.col("sales_last") - F.col("sales_prev"), F.col("sales_prev"))
    out = last2.withColumns({"d_spend": d_spend, "d_rev": d_rev})
    raw = sdiv(F.col("d_rev"), F.col("d_spend"))
    sat = F.when(F.col("d_spend") > 0.05, F.least(F.greatest(raw, F.lit(0.6)), F.lit(1.0)))
    return out.withColumn("saturation", F.coalesce(sat, F.lit(default)))


def growth_and_saturation(df: DataFrame, default: float = 0.85) -> DataFrame:
    """A3 and L3 together: (series_id, last_week, growth_rate, saturation) of each series.

    The rows move once, by series: years and series are then aggregated where they lie, and the
    trailing windows are exact sums of what their years hold of them.
    """
    by_series = Window.partitionBy("series_id")
    d = df.withColumn("last_week", F.max("week_start").over(by_series))
    in_ly, in_py = _trailing_windows()
    sales = F.col("net_sales").cast(SUM_TYPE)
    years = d.groupBy("series_id", "iso_year").agg(
        F.max("last_week").alias("last_week"), F.sum(F.when(in_ly, sales)).alias("ly"), F.sum(F.when(in_py, sales)).alias("py"),
        F.coalesce(xsum("ad_spend"), F.lit(0.0)).alias("ad_spend"), F.coalesce(xsum("net_sales"), F.lit(0.0)).alias("net_sales"))
    years = years.withColumn("rn", F.row_number().over(by_series.orderBy(F.desc("iso_year"))))
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    out = years.groupBy("series_id").agg(F.max("last_week").alias("last_week"), total("ly").alias("sales_ly"),
                                         total("py").alias("sales_py"), *_last_two_years())
    return _saturation(out, default).select("series_id", "last_week", _growth_rate().alias("growth_rate"), "saturation")


def _trailing_windows() -> tuple[Column, Column]:
    """Whether a week is among the 52 up to the last one, and among the 52 before those."""
    start_ly, start_py = F.date_sub(F.col("last_week"), 364), F.date_sub(F.col("last_week"), 728)
    return ((F.col("week_start") > start_ly) & (F.col("week_start") <= F.col("last_week")),
            (F.col("week_start") > start_py) & (F.col("week_start") <= start_ly))


def _growth_rate() -> Column:
    return F.when(F.col("sales_py") > 0, (F.col("sales_ly") - F.col("sales_py")) / F.col("sales_py")).otherwise(F.lit(0.0))


def trailing_growth(df: DataFrame) -> DataFrame:
    """A3: net sales in (last-52w, last] vs (last-104w, last-52w]; ratio - 1,
    0 when the earlier window is not positive."""
    w = Window.partitionBy("series_id")
    d = df.withColumn("last_week", F.max("week_start").over(w))
    in_ly, in_py = _trailing_windows()
    agg = d.groupBy("series_id").agg(
        F.max("last_week").alias("last_week"),
        F.coalesce(F.sum(F.when(in_ly, F.col("net_sales").cast(SUM_TYPE))).cast("double"), F.lit(0.0)).alias("sales_ly"),
        F.coalesce(F.sum(F.when(in_py, F.col("net_sales").cast(SUM_TYPE))).cast("double"), F.lit(0.0)).alias("sales_py"),
    )
    return agg.withColumn("growth_rate", _growth_rate())


def weekly_yoy_detail(df: DataFrame) -> DataFrame:
    """For every pair with common weeks, each ISO week present in either
    year with both years' spend and sales (missing -> 0), per-week changes and
    elasticity; weeks with spend in either year.

    Window passes only: weeks of the current year take last year's values
    from a same-week ``lag``; weeks present only in the previous year are
    emitted from that year's rows (a same-week ``lead`` that misses the next
    available year).
    """
    w_week = Window.partitionBy("series_id", "iso_week").orderBy("iso_year")
    w_series = Window.partitionBy("series_id").orderBy("iso_year")
    x = df.select(
        "series_id", "iso_year", "iso_week", "period_label",
        F.coalesce(F.col("ad_spend"), F.lit(0.0)).alias("spend"), F.coalesce(F.col("net_sales"), F.lit(0.0)).alias("sales"),
        F.lag("iso_year").over(w_week).alias("wk_prev_year"), F.lead("iso_year").over(w_week).alias("wk_next_year"),
        F.coalesce(F.lag("ad_spend").over(w_week), F.lit(0.0)).alias("lag_spend"),
        F.coalesce(F.lag("net_sales").over(w_week), F.lit(0.0)).alias("lag_sales"))
    x = x.withColumns({
        "prev_year": F.max("iso_year").over(w_series.rangeBetween(Window.unboundedPreceding, -1)),
        "next_year": F.min("iso_year").over(w_series.rangeBetween(1, Window.unboundedFollowing)),
    })
    common = F.col("wk_prev_year") == F.col("prev_year")
    cur = x.filter(F.col("prev_year").isNotNull()).select(
        "series_id", F.col("iso_year").alias("year"), "prev_year", "iso_week", "period_label",
        F.col("spend").alias("spend_curr"), F.col("sales").alias("sales_curr"),
        F.when(common, F.col("lag_spend")).otherwise(F.lit(0.0)).alias("spend_prev"),
        F.when(common, F.col("lag_sales")).otherwise(F.lit(0.0)).alias("sales_prev"),
        common.alias("is_common"))
    only_prev = x.filter(F.col("next_year").isNotNull()
                         & ~F.coalesce(F.col("wk_next_year") == F.col("next_year"), F.lit(False))).select(
        "series_id", F.col("next_year").alias("year"), F.col("iso_year").alias("prev_year"), "iso_week",
        F.lit(None).cast("string").alias("period_label"),
        F.lit(0.0).alias("spend_curr"), F.lit(0.0).alias("sales_curr"),
        F.col("spend").alias("spend_prev"), F.col("sales").alias("sales_prev"), F.lit(False).alias("is_common"))
    j = cur.unionByName(only_prev)
    j = j.withColumn("has_common", F.max(F.col("is_common").cast("int")).over(Window.partitionBy(*PAIR)))
    j = j.filter(F.col("has_common") == 1)
    d_spend = F.when(F.col("spend_prev") > 0, (F.col("spend_curr") - F.col("spend_prev"))
                     / F.col("spend_prev") * 100.0).otherwise(F.lit(0.0))
    d_rev = F.when(F.col("sales_prev") > 0, (F.col("sales_curr") - F.col("sales_prev"))
                   / F.col("sales_prev") * 100.0).otherwise(F.lit(0.0))
    j = j.withColumns({"delta_spend_pct": d_spend, "delta_sales_pct": d_rev})
    j = j.withColumn("elasticity", F.when(F.col("delta_spend_pct") != 0,
                                          F.col("delta_sales_pct") / F.col("delta_spend_pct"))
                     .otherwise(F.lit(0.0)))
    j = j.filter((F.col("spend_curr") > 0) | (F.col("spend_prev") > 0))
    return j.select(*PAIR, "iso_week", "period_label", "spend_curr", "spend_prev", "sales_curr",
                    "sales_prev", "delta_spend_pct", "delta_sales_pct", "elasticity")


_YEAR_SUMS = ("net_sales", "ad_spend", "orders", "impressions_a")
_YEAR_AVGS = ("returning_rate_pct", "cpc_a", "cpc_b", "cpm_b", "frequency_b")


def _year_block(side: str) -> list:
    sfx = "_" + side
    cols = [F.coalesce(_xs(c + sfx), F.lit(0.0)).alias(c + sfx) for c in _YEAR_SUMS]
    cols += [F.coalesce(_xs(c + sfx) / F.count(c + sfx), F.lit(0.0)).alias(c + sfx) for c in _YEAR_AVGS]
    ret_abs = F.sum(F.abs(F.col("returns" + sfx)).cast(SUM_TYPE)).cast("double")
    cols.append(F.coalesce(ret_abs, F.lit(0.0)).alias("returns_abs" + sfx))
    return cols


def _year_metrics(side: str) -> dict:
    """A9 derived metrics for one side of a pair (reference formulas)."""
    s = "_" + side
    sales, spend, orders = F.col("net_sales" + s), F.col("ad_spend" + s), F.col("orders" + s)
    aov = F.when(orders > 0, sales / orders).otherwise(F.lit(0.0))
    cpa = F.when(orders > 0, spend / orders).otherwise(F.lit(0.0))
    ret_rate = F.col("returning_rate_pct" + s) / 100.0
    ltv = F.when(ret_rate < 0.99, aov / (F.lit(1.0) - ret_rate)).otherwise(aov)
    return {
        "mer" + s: F.when(spend > 0, sales / spend).otherwise(F.lit(0.0)),
        "aov" + s: aov,
        "cpa" + s: cpa,
        "ltv" + s: ltv,
        "returns_pct" + s: F.when(sales > 0, F.col("returns_abs" + s) / sales * 100.0).otherwise(F.lit(0.0)),
    }


def yoy_health(df: DataFrame) -> DataFrame:
    """A9 + L5 + L6: year metrics of both years on their common weeks, deltas
    (relative for sales, CPA, AOV, CPM, CPC, impressions, LTV; absolute for
    MER, frequency, retention, returns, LTV/CPA) and diagnostic flags.

    Every adjacent pair with at least one common week gets a row (a pair
    without common weeks has no like-for-like basis and is omitted).
    """
    cols = list(_YEAR_SUMS) + list(_YEAR_AVGS) + ["returns"]
    agg = lfl_rows(df, cols).groupBy(*PAIR).agg(
        *_year_block("curr"), *_year_block("prev"),
        F.count(F.lit(1)).cast("int").alias("n_common_weeks"),
        F.sort_array(F.collect_list("iso_week")).alias("week_arr"),
    )
    out = agg.withColumns(_year_metrics("curr")).withColumns(_year_metrics("prev"))
    for side in ("curr", "prev"):
        s = "_" + side
        out = out.withColumn("ltv_cpa" + s, F.when(F.col("cpa" + s) > 0, F.col("ltv" + s) / F.col("cpa" + s))
                             .otherwise(F.lit(0.0)))

    def rel(name):
        c, p = F.col(name + "_curr"), F.col(name + "_prev")
        return F.when(p > 0, (c - p) / p * 100.0).otherwise(F.lit(0.0))

    def ab(name):
        return F.col(name + "_curr") - F.col(name + "_prev")

    out = out.withColumns({
        "delta_sales_pct": rel("net_sales"), "delta_mer": ab("mer"), "delta_cpa_pct": rel("cpa"),
        "delta_aov_pct": rel("aov"), "delta_cpm_pct": rel("cpm_b"), "delta_frequency": ab("frequency_b"),
        "delta_cpc_a_pct": rel("cpc_a"), "delta_cpc_b_pct": rel("cpc_b"),
        "delta_impressions_pct": rel("impressions_a"), "delta_retention_pt": ab("returning_rate_pct"),
        "delta_returns_pt": ab("returns_pct"), "delta_ltv_pct": rel("ltv"), "delta_ltv_cpa": ab("ltv_cpa"),
    })
    out = out.withColumns({
        "frequency_up": F.col("frequency_b_curr") > F.col("frequency_b_prev"),
        "cpm_rising": F.col("delta_cpm_pct") > 5,
        "ltv_up": F.col("ltv_curr") > F.col("ltv_prev"),
        "ltv_cpa_strong": F.col("ltv_cpa_curr") > 3,
    })
    # week list as text: numeric order, comma separated
    out = out.withColumn("week_list", F.array_join(F.transform("week_arr", lambda x: x.cast("string")), ","))
    keep = [*PAIR, "n_common_weeks", "week_list"]
    for side in ("curr", "prev"):
        s = "_" + side
        keep += [c + s for c in ("net_sales", "ad_spend", "orders", "mer", "aov", "cpa", "cpc_a", "cpc_b",
                                 "cpm_b", "frequency_b", "impressions_a", "returning_rate_pct",
                                 "returns_pct", "ltv", "ltv_cpa")]
    keep += ["delta_sales_pct", "delta_mer", "delta_cpa_pct", "delta_aov_pct", "delta_cpm_pct",
             "delta_frequency", "delta_cpc_a_pct", "delta_cpc_b_pct", "delta_impressions_pct",
             "delta_retention_pt", "delta_returns_pt", "delta_ltv_pct", "delta_ltv_cpa",
             "frequency_up", "cpm_rising", "ltv_up", "ltv_cpa_strong"]
    return out.select(*keep)


def common_weeks(df: DataFrame) -> DataFrame:
    """The common ISO weeks of each adjacent pair, one row per week."""
    return lfl_rows(df, []).select(*PAIR, "iso_week")
