"""Given order-line tables -> canonical weekly panel.

Plan shape (designed for very large ``lineitem`` / ``orders``):

1. ``orders`` joins ``customer`` on ``custkey`` (sort-merge at scale; AQE
   splits a hot customer), projecting only the series key and order facts.
2. ``lineitem`` joins that on ``orderkey`` as narrow rows (price, rates and
   flags).  Every sum adds up from lines, so the joined rows are reduced to
   (series, week) where they are: no wide sums per order or customer are held,
   sorted or shuffled, and a series with a third of all rows (e.g. ``ALL``)
   never lands whole in one task.
3. What counts orders and customers (orders, urgent ones, customers with
   finished lines) goes through a narrow row per order with lines and then per
   (series, week, customer).

Money stays ``decimal`` until the weekly totals are final, so the totals do
not depend on partitioning or task order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import iso_week, iso_year, week_range_label

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Per-segment multiplier used for the channel-spend stand-in.
SEGMENT_K = {
    "AUTOMOBILE": 5,
    "BUILDING": 7,
    "FURNITURE": 8,
    "HOUSEHOLD": 10,
    "MACHINERY": 14,
}
# Discount stand-in factor and the priority counted as returning.
DISCOUNT_FACTOR = Decimal("2.7")
RETURNING_PRIORITY = "1-URGENT"

GRAINS = ("all", "segment", "nation", "customer")

MONEY = "decimal(18,2)"
#: Holds rates to a millionth (8.25 % is 0.0825).
RATE = "decimal(9,6)"
#: How far a value may lie from its decimal form: the noise of binary fractions, not a further digit.
NOISE = 1e-9


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held(name: str, kind: str) -> F.Column:
    """The column as a decimal of ``kind``, never rounded on the way: a value with
    more digits than that fails the job and is named."""
    c = F.col(name)
    short = c.try_cast(kind)
    lost = c.isNotNull() & (short.isNull() | (F.abs(short.cast("double") - c.cast("double")) > NOISE * F.greatest(F.abs(c.cast("double")), F.lit(1.0))))
    fail = F.raise_error(F.concat(F.lit(f"{name} does not fit {kind}: "), c.cast("string")))
    return F.when(lost, fail.cast(kind)).otherwise(short)


def _money(c) -> F.Column:
    """Round an exact decimal total to cents, then hand it on as double."""
    return c.cast(MONEY).cast("double")


KEYS = ("series_id", "week_start")
ORDER_COLS = ("custkey", "urgent")
ROW_SUMS = ("ext", "disc", "net", "ret_net", "qty", "net_a", "net_b", "lines_a", "lines_b", "qty_a", "qty_b")
LINE_COLS = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
             "l_linestatus")


def order_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregates (one row per ``l_orderkey``)."""
    return line_totals(load(spark, sf_dir, "lineitem").select(*LINE_COLS))


def line_rows(li: DataFrame, *also: str) -> DataFrame:
    """What the measures need of order lines, a narrow row per line: exact price and rates, flags, and ``also``."""
    return li.select(
        *also, F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").alias("qty"),
        held("l_extendedprice", MONEY).alias("ext"), held("l_discount", RATE).alias("discount"), held("l_tax", RATE).alias("tax"),
        (F.col("l_returnflag") == "R").alias("is_r"), (F.col("l_linestatus") == "O").alias("is_a"),
        (F.col("l_linestatus") == "F").alias("is_b"))


def line_terms() -> dict[str, F.Column]:
    """What a row of :func:`line_rows` adds to each sum."""
    ext, qty = F.col("ext"), F.col("qty")
    disc = F.lit(DISCOUNT_FACTOR).cast("decimal(2,1)") * ext * F.col("discount")
    net = ext - disc
    tax_base = ext * F.col("tax")
    one = F.lit(1).cast("long")
    return {
        "ext": ext, "disc": disc, "net": net, "ret_net": F.when(F.col("is_r"), net), "qty": qty,
        "tax_a": F.when(F.col("is_a"), tax_base), "tax_b": F.when(F.col("is_b"), tax_base),
        "net_a": F.when(F.col("is_a"), net), "net_b": F.when(F.col("is_b"), net),
        "lines_a": F.when(F.col("is_a"), one).otherwise(one - one), "lines_b": F.when(F.col("is_b"), one).otherwise(one - one),
        "qty_a": F.when(F.col("is_a"), qty), "qty_b": F.when(F.col("is_b"), qty),
    }


def line_totals(li: DataFrame, *also: str) -> DataFrame:
    """Per-order aggregates of any set of order lines (batch or micro-batch), per order and ``also``."""
    return order_sums(line_rows(li, *also), *also)


def order_sums(rows: DataFrame, *also: str) -> DataFrame:
    """Sums of :func:`line_rows` per order and ``also``."""
    return rows.groupBy(*also, "orderkey").agg(*[F.sum(c).alias(name) for name, c in line_terms().items()])


def spend_multiplier(segment, multipliers: dict[str, int] = SEGMENT_K, default: int | None = None) -> F.Column:
    """The multiplier of a customer segment.  A segment without one takes
    ``default``; without a default the job fails and names the segment, since
    its spend would otherwise vanish from every ratio."""
    segment = F.col(segment) if isinstance(segment, str) else segment
    known = F.create_map(*[F.lit(x) for kv in multipliers.items() for x in kv])[segment]
    missing = F.raise_error(F.concat(F.lit("no spend multiplier for segment "), F.coalesce(segment, F.lit("NULL"))))
    return F.coalesce(known, missing.cast("int") if default is None else F.lit(default))


def _series_orders(spark: SparkSession, sf_dir: str, grain: str, multipliers: dict[str, int] = SEGMENT_K,
                   default_multiplier: int | None = None) -> DataFrame:
    """Orders with week, priority flag, customer and series key."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        F.date_trunc("week", F.col("o_orderdate").cast("date")).cast("date").alias("week_start"),
        (F.col("o_orderpriority") == RETURNING_PRIORITY).alias("urgent"),
    )
    # the multiplier is looked up after the join: only segments of customers with orders must be known
    return orders.join(series_of_customers(spark, sf_dir, grain), "custkey").withColumn(
        "k", spend_multiplier("segment", multipliers, default_multiplier))


def series_of_customers(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    """(custkey, segment, series_id): the series that each customer's orders and sessions count for."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    cust = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    if grain == "nation":
        nation = load(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("series_id"))
        return cust.join(nation, "c_nationkey").select("custkey", "segment", "series_id")
    series = {"all": F.lit("ALL"), "segment": F.col("segment"), "customer": F.col("custkey").cast("string")}[grain]
    return cust.select("custkey", "segment", series.alias("series_id"))


def weekly_rollup(spark: SparkSession, sf_dir: str, grain: str = "segment",
                  lines: DataFrame | None = None, multipliers: dict[str, int] = SEGMENT_K,
                  default_multiplier: int | None = None, buckets: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Order lines -> raw weekly fact (F-2 base measures, before P8/P9).

    Channel measures are stand-ins (see FIXTURES.md): channel ``a`` = open
    lines, ``b`` = finished lines; spend = k * ext * tax.  ``lines`` may be
    given as per-order totals (e.g. merged streaming increments).  With
    ``buckets`` the narrow rows are dealt once by series into so many parts,
    and everything after stays there (see :func:`weekly_from_sums`).
    """
    orders = _series_orders(spark, sf_dir, grain, multipliers, default_multiplier)
    if lines is not None:
        return weekly_from_orders(orders.join(lines, "orderkey"))
    li = load(spark, sf_dir, "lineitem")
    # lines stream past the orders of their partition: neither side is sorted
    rows = line_rows(li).join(orders.select("orderkey", *KEYS, "k").hint("shuffle_hash"), "orderkey")
    rows = by_series(rows.drop("orderkey"), buckets).withColumns(line_terms())
    with_lines = li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max(F.col("l_linestatus") == "F").alias("has_b"))
    counted = with_lines.join(orders.select("orderkey", *KEYS, *ORDER_COLS).hint("shuffle_hash"), "orderkey")
    return weekly_from_sums(rows, by_series(counted.select(*KEYS, *ORDER_COLS, "has_b"), buckets),
                            None if sessions is None else by_series(sessions, buckets))


def by_series(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by series into ``parts``; without that where they are."""
    return rows.repartition(parts, "series_id") if parts else rows


def weekly_from_orders(facts: DataFrame) -> DataFrame:
    """The weekly fact of orders with their series, week, customer, flag, multiplier and line totals."""
    return weekly_from_sums(facts, facts.select(*KEYS, *ORDER_COLS, (F.col("lines_b") > 0).alias("has_b")))


def weekly_from_sums(rows: DataFrame, orders: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The weekly fact of ``rows`` (series, week, multiplier and the sums, or parts of them, of any number of rows
    an order) and ``orders`` (series, week, customer, flag, whether it has finished lines).

    Sums add up from any rows, so they are reduced per (series, week) before they are shuffled, and only
    what counts orders and customers goes through a row per customer: a few narrow columns.
    If all of them are dealt by series, as where a series has about one order a week and reducing first gains
    nothing, no wide row is shuffled at all; ``sessions`` (series, week, sessions) then come with the sums, not by a join.
    """
    k = F.col("k").cast("decimal(4,0)")
    sums = {**{c: F.sum(c) for c in ROW_SUMS}, "spend_a": F.sum(k * F.col("tax_a")), "spend_b": F.sum(k * F.col("tax_b"))}
    summed = rows.groupBy(*KEYS).agg(*[c.alias(name) for name, c in sums.items()])
    per_cust = orders.groupBy(*KEYS, "custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count(F.when(F.col("urgent"), 1)).alias("n_urgent"), F.max("has_b").alias("has_b"))
    counted = per_cust.groupBy(*KEYS).agg(
        F.sum("n_orders").alias("n_orders"), F.sum("n_urgent").alias("n_urgent"), F.count(F.when(F.col("has_b"), 1)).alias("cust_b"))
    # a union, not a join: a series or week may be null
    every, more = summed.unionByName(counted, allowMissingColumns=True), []
    if sessions is not None:
        every = every.withColumn("sold", F.lit(True)).unionByName(sessions, allowMissingColumns=True)
        more = [F.max("sold").alias("sold"), F.sum("sessions").cast("double").alias("sessions")]
    wk = every.groupBy(*KEYS).agg(
        _money(F.sum("ext")).alias("gross_sales"),
        _money(F.sum("net")).alias("total_sales"),
        _money(-F.sum("disc")).alias("discounts"),
        _money(-F.sum("ret_net")).alias("returns"),
        F.sum("n_orders").cast("double").alias("orders"),
        F.sum("qty").alias("items"),
        _money(F.sum("spend_a")).alias("spend_a"),
        _money(F.sum("spend_b")).alias("spend_b"),
        _money(F.sum("net_a")).alias("conv_value_a"),
        _money(F.sum("net_b")).alias("conv_value_b"),
        F.sum("lines_a").alias("lines_a"),
        F.sum("lines_b").alias("lines_b"),
        F.sum("qty_a").alias("impressions_a"),
        F.sum("qty_b").alias("qty_b"),
        F.sum("cust_b").alias("cust_b"),
        F.sum("n_urgent").alias("n_urgent"),
        *more,
    )
    if sessions is not None:
        wk = wk.filter("sold")
    return wk.select(
        "series_id", "week_start",
        iso_year("week_start").alias("iso_year"),
        iso_week("week_start").alias("iso_week"),
        week_range_label("week_start").alias("period_label"),
        "spend_a", "spend_b", "total_sales", "gross_sales", "discounts", "returns", "orders",
        F.col("items").cast("double").alias("items"),
        F.round(F.try_divide(F.col("total_sales"), F.col("orders")), 6).alias("aov"),
        F.round(F.try_divide(F.col("n_urgent").cast("double") * 100.0, F.col("orders")), 6)
        .alias("returning_rate_pct"),
        "conv_value_a", "conv_value_b",
        F.round(F.try_divide(F.col("spend_a"), F.col("lines_a").cast("double")), 6).alias("cpc_a"),
        F.round(F.try_divide(F.col("spend_b"), F.col("lines_b").cast("double")), 6).alias("cpc_b"),
        F.round(F.try_divide(F.col("spend_b") * 1000.0, F.col("qty_b")), 6).alias("cpm_b"),
        F.col("impressions_a").cast("double").alias("impressions_a"),
        F.round(F.try_divide(F.col("lines_b").cast("double") * 0.6, F.col("cust_b").cast("double")), 6)
        .alias("frequency_b"),
        *(["sessions"] if sessions is not None else []),
    )
