"""Ordered operators W1-W5, W7: every window is partitioned by ``series_id``
(an unpartitioned window would run in a single task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import SUM_TYPE



def w_series():
    """Rows of one series in week order."""
    return Window.partitionBy("series_id").orderBy("week_start")


def w_series_desc():
    return Window.partitionBy("series_id").orderBy(F.desc("week_start"))


def lag_features(df: DataFrame, lags=(1, 4), col: str = "net_sales") -> DataFrame:
    """``col`` k rows back for each k in ``lags`` (``lag_k``)."""
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(w_series()) for k in lags})


def rolling_mean(df: DataFrame, col: str, n: int = 4, name: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows including the current; NULL until ``n``
    values exist (pandas ``rolling(n).mean()``)."""
    w = w_series().rowsBetween(-(n - 1), 0)
    s = F.sum(F.col(col).cast(SUM_TYPE)).over(w).cast("double")
    c = F.count(F.col(col)).over(w)
    return df.withColumn(name or f"{col}_roll{n}", F.when(c == n, s / F.lit(float(n))))


def rolling_return_rate(df: DataFrame, n: int = 4) -> DataFrame:
    """``n``-week rolling mean of the return rate next to ad spend (the
    data behind the spend-vs-returns chart)."""
    out = rolling_mean(df, "return_rate_pct", n, "return_rate_roll")
    return out.select("series_id", "week_start", "ad_spend", "return_rate_pct", "return_rate_roll")


def recency_rank(df: DataFrame, name: str = "rn_desc") -> DataFrame:
    """W3 helper: 1 for the newest week of each series, 2 for the one before…"""
    return df.withColumn(name, F.row_number().over(w_series_desc()))


def last_periods(df: DataFrame, order_col: str, n: int = 12) -> DataFrame:
    """The ``n`` newest periods per series by ``order_col``."""
    w = Window.partitionBy("series_id").orderBy(F.desc(order_col))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def share_of_mean(df: DataFrame, col: str, name: str) -> DataFrame:
    """Value divided by its series mean."""
    w = Window.partitionBy("series_id")
    mean = F.sum(F.col(col).cast(SUM_TYPE)).over(w).cast("double") / F.count(F.col(col)).over(w)
    return df.withColumn(name, F.try_divide(F.col(col), mean))


def origin_lags(df: DataFrame, col: str = "net_sales") -> DataFrame:
    """Lag 1 and lag 4 at each row; lag 4 falls back to lag 1 when the
    row has four or fewer predecessors."""
    n_before = F.row_number().over(w_series()) - 1
    l1 = F.lag(col, 1).over(w_series())
    l4 = F.lag(col, 4).over(w_series())
    return df.withColumns({"o_lag_1": l1, "o_lag_4": F.when(n_before > 4, l4).otherwise(l1)})


def first_per_key(df: DataFrame, keys, order_col: str = "week_start") -> DataFrame:
    """O3: the first row per key by ``order_col`` (duplicates ignored)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
