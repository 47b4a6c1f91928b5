"""External context: A10 day weather, A11 month weather, A12 month ledger base,
J5 business on a day, J6 month events, J7 ledger, D13 macro tag.

The event calendar and macro tags are literal dimensions; they are applied
as map lookups on the month number (the broadcast-join equivalent for a
fixed literal table), so the ledger needs no join for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import xavg, xsum
from ..sources.calendar import EVENTS, city_rank_map
from .prepare import last_n_days

WEATHER_FALLBACK_TEMP = 15.0
WEATHER_FALLBACK_RAIN = 40.0


def month_events_map():
    """Month number -> comma-joined event titles (calendar order)."""
    by_month: dict[int, list[str]] = {}
    for month, title in EVENTS:
        by_month.setdefault(month, []).append(title)
    kv = []
    for m in sorted(by_month):
        kv += [F.lit(m), F.lit(", ".join(by_month[m]))]
    return F.create_map(*kv)


def macro_tag(month_col) -> F.Column:
    """Inflation context label for a month start date."""
    m = F.col(month_col) if isinstance(month_col, str) else month_col
    y, mo = F.year(m), F.month(m)
    return (F.when((y == 2024) & (mo > 9), "0.7% (deflation)")
            .when(y == 2025, "1.0% (stable)").otherwise("1.2%"))


def day_weather(weather: DataFrame) -> DataFrame:
    """A10: per day mean max-temperature, max and total rain, hottest city
    (ties: first city of the city dimension, then name)."""
    rank = city_rank_map()[F.col("city")]
    w = weather.withColumn("__rank", F.coalesce(rank, F.lit(10 ** 6)))
    return w.groupBy("date").agg(
        xavg("temp").alias("avg_temp"),
        F.max("rain").alias("max_rain"),
        xsum("rain").alias("total_rain"),
        F.min_by("city", F.when(F.col("temp").isNotNull(),
                                F.struct(-F.col("temp"), F.col("__rank"), F.col("city")))).alias("hottest_city"),
        F.count("temp").alias("n_cities"),
    )


def month_weather(weather: DataFrame) -> DataFrame:
    """Mean temperature and mean daily rain per month (all cities)."""
    return weather.groupBy(F.trunc("date", "MM").alias("month")).agg(
        xavg("temp").alias("avg_temp"), xavg("rain").alias("avg_daily_rain_mm"))


def business_on_day(df: DataFrame, weather_days: DataFrame) -> DataFrame:
    """Weekly sales whose week starts on a weather day, with that day's
    weather and the week's MER."""
    d = weather_days.withColumnRenamed("date", "week_start")
    j = df.select("series_id", "week_start", "net_sales", "ad_spend").join(d, "week_start")
    return j.withColumn("mer", F.when(F.col("ad_spend") > 0, F.col("net_sales") / F.col("ad_spend"))
                        .otherwise(F.lit(0.0)))


def month_ledger_base(df: DataFrame, days: int = 365) -> DataFrame:
    """Last ``days`` days per series, by month: sales, spend, first week,
    MER (NULL without spend)."""
    x = last_n_days(df, days).withColumn("month", F.trunc("week_start", "MM"))
    m = x.groupBy("series_id", "month").agg(
        F.coalesce(xsum("net_sales"), F.lit(0.0)).alias("net_sales"),
        F.coalesce(xsum("ad_spend"), F.lit(0.0)).alias("ad_spend"),
        F.min("week_start").alias("first_week"),
    )
    return m.withColumn("mer", F.try_divide(F.col("net_sales"), F.col("ad_spend")))


def ledger(df: DataFrame, weather: DataFrame | None = None, days: int = 365) -> DataFrame:
    """Month ledger - KPIs, weather (fallback 15.0 C / 40 mm), events of
    the month ('none' if no event) and the macro tag."""
    m = month_ledger_base(df, days)
    if weather is not None:
        mw = month_weather(weather)
        m = m.join(mw, "month", "left")
    else:
        m = m.withColumns({"avg_temp": F.lit(None).cast("double"),
                           "avg_daily_rain_mm": F.lit(None).cast("double")})
    events = F.coalesce(month_events_map()[F.month("month")], F.lit("none"))
    m = m.withColumns({
        "avg_temp": F.coalesce(F.col("avg_temp"), F.lit(WEATHER_FALLBACK_TEMP)),
        "avg_daily_rain_mm": F.coalesce(F.col("avg_daily_rain_mm"), F.lit(WEATHER_FALLBACK_RAIN)),
        "events": events,
        "macro": macro_tag("month"),
    })
    return m.select(
        "series_id", "month", F.date_format("month", "yyyy-MM").alias("month_label"), "first_week",
        "net_sales", "ad_spend", "mer", "avg_temp", "avg_daily_rain_mm", "events", "macro",
        F.concat(F.col("events"), F.lit(" | Infl. "), F.col("macro")).alias("context"),
    )
