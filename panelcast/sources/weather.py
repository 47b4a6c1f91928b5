"""S3: weather payload (JSON, one city per record with parallel daily arrays)
-> city x day rows with temperature band (P13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import weather_band, weather_marker_size

WEATHER_SCHEMA = ("city string, lat double, lon double, daily struct<time: array<string>, "
                  "temperature_2m_max: array<double>, precipitation_sum: array<double>>")


def flatten_weather(raw: DataFrame) -> DataFrame:
    """Zip the parallel arrays and explode: one row per (city, day).  NULL
    temperatures stay NULL (they do not abort the parse)."""
    z = raw.select("city", "lat", "lon", F.explode(F.arrays_zip(
        F.col("daily.time").alias("time"), F.col("daily.temperature_2m_max").alias("temp"),
        F.col("daily.precipitation_sum").alias("rain"))).alias("z"))
    out = z.select(F.to_date("z.time").alias("date"), "city", "lat", "lon",
                   F.col("z.temp").alias("temp"), F.col("z.rain").alias("rain"))
    return out.withColumns({"band": weather_band("temp"), "marker_size": weather_marker_size("rain")})


def parse_weather(text: DataFrame, column: str = "value") -> DataFrame:
    """S3 from JSON text, one record a row; text that is no record gives no rows."""
    return flatten_weather(text.select(F.from_json(column, WEATHER_SCHEMA).alias("r")).filter("r.daily is not null").select("r.*"))


def read_weather(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S3: read the weather JSON with an explicit schema and flatten it."""
    raw = spark.read.schema(WEATHER_SCHEMA).option("multiLine", multiline).json(path)
    return flatten_weather(raw)
