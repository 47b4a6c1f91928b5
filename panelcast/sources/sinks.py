"""Sinks and listings: S5 weekly history, S6 channel history, durable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY_COLS = ("series_id", "week_start", "period_label", "total_sales", "spend_a", "conv_value_a", "cpc_a",
                "impressions_a", "spend_b", "conv_value_b", "cpc_b", "cpm_b", "frequency_b",
                "cost_of_sales_pct", "op_profit")


def weekly_history(df: DataFrame) -> DataFrame:
    """The cleaned fact's display columns that exist (newest first when
    listed; ordering is applied by the caller with :func:`newest_first`)."""
    return df.select(*[c for c in HISTORY_COLS if c in df.columns])


def channel_history(df: DataFrame) -> DataFrame:
    """Per channel spend, conversion value, ROAS and CPC (plus CPM and
    frequency for channel b), one row per (series, week, channel)."""
    a = df.select("series_id", "week_start", "period_label", F.lit("a").alias("channel"),
                  F.col("spend_a").alias("spend"), F.col("conv_value_a").alias("conv_value"),
                  F.col("roas_a").alias("roas"), F.col("cpc_a").alias("cpc"),
                  F.lit(None).cast("double").alias("cpm"), F.lit(None).cast("double").alias("frequency"))
    b = df.select("series_id", "week_start", "period_label", F.lit("b").alias("channel"),
                  F.col("spend_b").alias("spend"), F.col("conv_value_b").alias("conv_value"),
                  F.col("roas_b").alias("roas"), F.col("cpc_b").alias("cpc"),
                  F.col("cpm_b").alias("cpm"), F.col("frequency_b").alias("frequency"))
    return a.unionByName(b)


def newest_first(df: DataFrame, col: str = "week_start") -> DataFrame:
    """O1: descending listing (a global sort - use for display / export)."""
    return df.orderBy(F.col("series_id"), F.desc(col))


def write_bucketed_fact(df: DataFrame, path: str, table: str) -> DataFrame:
    """Durable weekly table in buckets of series, each sorted by series and week; the table read back.

    As many buckets as shuffles have partitions: what is joined with it by series moves
    only the other side, and windows by series move nothing.  The rows are written where they are: unless
    they are dealt by series into as many parts before, each part writes a file of its own to many buckets.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.bucketBy(buckets, "series_id").sortBy("series_id", "week_start")
     .format("parquet").option("path", path).saveAsTable(table))
    return spark.table(table)


def write_weekly_fact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Durable weekly table partitioned by ISO year (later reads prune years)."""
    df.write.mode(mode).partitionBy("iso_year").parquet(path)
