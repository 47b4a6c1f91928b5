"""The weather family (S3, A10, A11, J5, J7, P13) as registered queries.

The payload is text, as a weather service answers it: one JSON record per city
with parallel daily arrays.  It is rendered from the given tables - a city per
nation, a day per order date, readings worked out from both, with gaps - and read
back by the library's own parser, so every step from text to ledger is on the
checked path.  The arrays of one city are as long as the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import round_doubles
from ..operators import context
from ..operators.prepare import weekly_panel
from ..sources.tables import load
from ..sources.weather import parse_weather
from .registry import GRAIN, register


def weather_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): one JSON record per city.

    Readings of a city: 0.1 * ((37 * city + 13 * day) mod 430) - 6 degrees, none where
    (city + day) mod 19 is 0; 0.1 * ((11 * city + 7 * day) mod 90) mm of rain, none where
    (city + 2 * day) mod 23 is 0; ``day`` counts from 1970.
    """
    days = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    days = days.agg(F.sort_array(F.collect_list("date")).alias("dates"))  # one value, an entry a day of the calendar
    city = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("k"), F.initcap("n_name").alias("city"), days.scalar().alias("dates"))
    day = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long")
    k = F.col("k")
    temp = lambda d: F.when((k + day(d)) % 19 != 0, ((37 * k + 13 * day(d)) % 430 - 60).cast("double") / 10.0)
    rain = lambda d: F.when((k + 2 * day(d)) % 23 != 0, ((11 * k + 7 * day(d)) % 90).cast("double") / 10.0)
    daily = F.struct(F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd")).alias("time"),
                     F.transform("dates", temp).alias("temperature_2m_max"), F.transform("dates", rain).alias("precipitation_sum"))
    record = F.struct("city", (40.0 + k % 10).cast("double").alias("lat"), (8.0 + k % 10).cast("double").alias("lon"), daily.alias("daily"))
    return city.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_weather(weather_payload(spark, sf_dir))


@register("weather_cities")
def q_weather_cities(spark, sf_dir):
    """S3 + P13: per city and band the days, mean marker size and the first and last day."""
    from ..functions.exact import xavg

    w = weather(spark, sf_dir)
    return round_doubles(w.groupBy("city", "band").agg(
        F.count("*").alias("days"), xavg("marker_size").alias("mean_marker_size"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day")))


@register("weather_days")
def q_weather_days(spark, sf_dir):
    return round_doubles(context.day_weather(weather(spark, sf_dir)))


@register("weather_months")
def q_weather_months(spark, sf_dir):
    return round_doubles(context.month_weather(weather(spark, sf_dir)))


@register("business_on_day")
def q_business_on_day(spark, sf_dir):
    days = context.day_weather(weather(spark, sf_dir))
    return round_doubles(context.business_on_day(weekly_panel(spark, sf_dir, GRAIN), days))


@register("month_ledger_weather")
def q_month_ledger_weather(spark, sf_dir):
    """J7 with weather; months in which no city has a reading (every fourth is left out) take the fallback."""
    w = weather(spark, sf_dir).filter(F.month("date") % 4 != 0)
    return round_doubles(context.ledger(weekly_panel(spark, sf_dir, GRAIN), w))
