"""Weekly fact preparation: P5 drop undated, P8 fill zero, P9 derived metrics,
P16 last-n-days, duplicate-week collapse and the canonical weekly fact."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.economics import TABLE_ECONOMICS, Economics, economics_columns
from ..functions.exact import SUM_TYPE, sdiv
from ..sources.sinks import write_bucketed_fact, write_weekly_fact

# Base measures of the weekly fact (F-2), in canonical order.
BASE_MEASURES = (
    "spend_a", "spend_b", "total_sales", "gross_sales", "discounts", "returns", "orders", "items",
    "aov", "returning_rate_pct", "conv_value_a", "conv_value_b", "cpc_a", "cpc_b", "cpm_b",
    "impressions_a", "frequency_b", "sessions",
)
# Measures that are ratios; duplicates of a week are averaged, not summed.
RATIO_MEASURES = ("aov", "returning_rate_pct", "cpc_a", "cpc_b", "cpm_b", "frequency_b")
KEYS = ("series_id", "week_start")
CALENDAR = ("iso_year", "iso_week", "period_label")
DERIVED = ("net_sales", "ad_spend", "mer", "return_rate_pct", "cost_of_sales_pct", "op_profit",
           "roas_a", "roas_b")


def drop_undated(df: DataFrame) -> DataFrame:
    """P5: rows without a week are dropped (order lives in windows)."""
    return df.filter(F.col("week_start").isNotNull())


def collapse_duplicate_weeks(df: DataFrame) -> DataFrame:
    """Sum a week that occurs twice in one series (ratios are averaged).

    Must run before any self-join on (series, week) so a duplicated week
    cannot multiply rows.
    """
    present = [c for c in BASE_MEASURES if c in df.columns]
    aggs = []
    for c in present:
        if c in RATIO_MEASURES:
            aggs.append((F.sum(F.col(c).cast(SUM_TYPE)).cast("double") / F.count(c)).alias(c))
        else:
            aggs.append(F.sum(F.col(c).cast(SUM_TYPE)).cast("double").alias(c))
    extra = [F.first(c, ignorenulls=True).alias(c) for c in CALENDAR if c in df.columns]
    return df.groupBy(*KEYS).agg(*extra, *aggs)


def fill_zero(df: DataFrame, present: list[str] | None = None) -> DataFrame:
    """NULL -> 0 in the base measures present in the input (columns the
    input never had stay NULL)."""
    cols = [c for c in (present if present is not None else BASE_MEASURES) if c in df.columns]
    return df.na.fill(0.0, subset=cols)


def orders_or_fallback(df: DataFrame, econ: Economics = TABLE_ECONOMICS):
    """Orders, or net sales / AOV where a file has no orders."""
    fallback = F.greatest(F.col("total_sales"), F.lit(0.0)) / F.lit(float(econ.aov))
    return F.coalesce(F.col("orders"), fallback) if "orders" in df.columns else fallback


def with_orders(df: DataFrame, econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """The frame with the fallback in ``orders``, for the operators that divide by
    orders (AOV, CPA, LTV); without it an absent column stays NULL."""
    return df.withColumn("orders", orders_or_fallback(df, econ))


def derive_metrics(df: DataFrame, econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """Net sales, ad spend, MER, rates, operating profit, channel ROAS.

    Ratios with a zero base are NULL for ROAS and 0 for the rates that are filled (MER, return rate, cost of sales).
    """
    ppo = economics_columns(econ)["profit_per_order"]
    orders = orders_or_fallback(df, econ)
    net_sales = F.greatest(F.col("total_sales"), F.lit(0.0))
    ad_spend = F.nullif(F.col("spend_a") + F.col("spend_b"), F.lit(0.0))
    out = df.withColumns({"net_sales": net_sales, "ad_spend": ad_spend})
    return out.withColumns({
        "mer": F.round(F.coalesce(sdiv("total_sales", "ad_spend"), F.lit(0.0)), 6),
        "return_rate_pct": F.round(F.coalesce(
            sdiv(F.abs(F.col("returns")), F.col("total_sales")) * 100.0, F.lit(0.0)), 6),
        "cost_of_sales_pct": F.round(F.coalesce(sdiv("ad_spend", "net_sales") * 100.0, F.lit(0.0)), 6),
        "op_profit": F.round(orders * ppo - F.col("ad_spend"), 6),
        "roas_a": F.round(sdiv("conv_value_a", "spend_a"), 6),
        "roas_b": F.round(sdiv("conv_value_b", "spend_b"), 6),
    })


def prepare(df: DataFrame, econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """P5 + duplicate collapse + P8 + P9 on a raw weekly fact."""
    df = drop_undated(df)
    df = collapse_duplicate_weeks(df)
    df = fill_zero(df)
    return derive_metrics(df, econ)


def weekly_fact(spark: SparkSession, sf_dir: str, grain: str = "segment",
                econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """Canonical weekly fact from the given tables (S7 -> P8 -> P9).

    The rollup already yields one row per (series, week), so no duplicate
    collapse is needed here.  The sessions of a week come from ``events``; weeks
    without sales are no weeks of the fact, whatever sessions they have.
    Of the bucketed grains the rows are dealt into their buckets as they come from
    the lines, so that the wide weeks are neither joined nor moved.
    """
    from ..sources.tables import weekly_rollup
    from .sessions import weekly_sessions

    if grain in BUCKETED_GRAINS:
        found = weekly_sessions(spark, sf_dir, grain).select(*KEYS, "sessions")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return derive_metrics(fill_zero(weekly_rollup(spark, sf_dir, grain, buckets=buckets, sessions=found)), econ)
    return derive_metrics(fill_zero(with_sessions(spark, sf_dir, weekly_rollup(spark, sf_dir, grain), grain)), econ)


def with_sessions(spark: SparkSession, sf_dir: str, weeks: DataFrame, grain: str) -> DataFrame:
    """The raw weekly fact with the ``sessions`` of each series and week."""
    from .sessions import weekly_sessions

    found = weekly_sessions(spark, sf_dir, grain).select(*KEYS, F.col("sessions").cast("double").alias("sessions"))
    return weeks.join(found, list(KEYS), "left")


def last_n_days(df: DataFrame, days: int = 365) -> DataFrame:
    """Rows whose week is later than (series' last week - days)."""
    w = Window.partitionBy("series_id")
    return (df.withColumn("__max_week", F.max("week_start").over(w))
            .filter(F.col("week_start") > F.date_sub(F.col("__max_week"), days))
            .drop("__max_week"))


_PANELS: dict = {}
#: Grains with so many series that windows and joins by series should find their rows in place.
BUCKETED_GRAINS = ("customer",)


def source_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and modification time of every source file, asked of the
    file system that holds them (any that Spark can read)."""
    stamp = []
    for t in ("lineitem", "orders", "customer", "nation", "events"):
        stamp += table_files(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
    return tuple(sorted(stamp))


def table_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of the data files of a table; none if it does not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    if not system.exists(path):
        return []
    files, out = system.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toUri().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def weekly_panel(spark: SparkSession, sf_dir: str, grain: str = "segment",
                 econ: Economics = TABLE_ECONOMICS) -> DataFrame:
    """The weekly fact, materialised once per (application, source, grain).

    The panel is computed from the raw tables once and written as Parquet,
    partitioned by ISO year, in the shared checkpoint folder; every analysis
    reads the columns and years it needs from there.  With a series per customer
    it is bucketed and sorted by series instead, so that windows by series need no
    shuffle.  The sources' files,
    sizes and modification times are kept with it, so changed inputs are
    re-rolled, and the panel they replace is forgotten.
    """
    from ..session import checkpoint_dir

    key, stamp = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), grain, econ), source_stamp(spark, sf_dir)
    if _PANELS.get(key, (None,))[0] != stamp:
        fact = weekly_fact(spark, sf_dir, grain, econ)
        name = uuid.uuid4().hex
        path = f"{checkpoint_dir(spark).rstrip('/')}/panel-{grain}-{name}"
        if grain in BUCKETED_GRAINS:
            panel = write_bucketed_fact(fact, path, f"panelcast_panel_{name}")
        else:
            write_weekly_fact(fact, path)
            panel = spark.read.schema(fact.schema).parquet(path).select(*fact.columns)
        for k in [k for k in _PANELS if k[0] != key[0]]:  # of applications that have ended
            del _PANELS[k]
        _PANELS[key] = (stamp, panel)
    return _PANELS[key][1]
