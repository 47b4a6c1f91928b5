"""Raw-text frames derived from the given tables for the cleaning operators.

A weekly CSV arrives as text; the given tables are typed.  These frames
render every order date / every line price in the textual shapes a weekly
file carries (valid, padded, malformed), so the parsers run over whole
tables: each row yields one string per shape (a literal array exploded).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean_currency, clean_number, clean_percentage, parse_iso_week
from ..functions.exact import xsum_cells
from ..operators.prepare import BASE_MEASURES, RATIO_MEASURES, weekly_panel, with_orders
from ..session import checkpoint_dir
from ..sources.tables import load
from ..sources.weekly_csv import HEADER_MAP, MONEY, PERCENT, REQUIRED, weekly_csv_rejects, weekly_from_csv, weekly_from_text


def _pad2(c):
    return F.lpad(c.cast("string"), 2, "0")


def week_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates rendered as 'YYYYWW' text in eight shapes."""
    d = F.col("o_orderdate").cast("date")
    iso = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), _pad2(F.weekofyear(d)))
    cal = F.concat(F.year(d).cast("string"), _pad2(F.ceil(F.dayofyear(d) / 7)))
    shapes = F.array(
        F.struct(F.lit("iso").alias("shape"), iso.alias("raw")),
        F.struct(F.lit("calendar").alias("shape"), cal.alias("raw")),
        F.struct(F.lit("padded").alias("shape"), F.concat(F.lit(" "), iso, F.lit(" ")).alias("raw")),
        F.struct(F.lit("float").alias("shape"), F.concat(iso, F.lit(".0")).alias("raw")),
        F.struct(F.lit("short").alias("shape"), F.substring(iso, 1, 5).alias("raw")),
        F.struct(F.lit("dashed").alias("shape"),
                 F.concat(F.year(d).cast("string"), F.lit("-"), _pad2(F.weekofyear(d))).alias("raw")),
        F.struct(F.lit("nbsp").alias("shape"), F.concat(iso, F.lit("\u00a0\u2009")).alias("raw")),
        F.struct(F.lit("week0").alias("shape"), F.concat(F.year(d).cast("string"), F.lit("00")).alias("raw")),
    )
    return load(spark, sf_dir, "orders").select(
        F.explode(shapes).alias("s")).select("s.*")


def parse_iso_week_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 over every order date in every shape: distinct text -> Monday."""
    t = week_text(spark, sf_dir)
    return t.groupBy("shape", "raw").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "week_start", parse_iso_week("raw"))


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices rendered as money text in nine shapes.  The shared pieces
    (plain text, thousands groups, cents) are projected once per line before
    the explode."""
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    whole = F.floor(ext).cast("bigint")
    base = load(spark, sf_dir, "lineitem").select(ext.alias("ext"), whole.alias("whole"))
    th = (F.col("whole") / 1000).cast("bigint")
    rest = F.lpad((F.col("whole") % 1000).cast("string"), 3, "0")
    parts = base.select(
        F.col("ext").cast("string").alias("plain"),
        F.lpad(((F.col("ext") - F.col("whole")) * 100).cast("int").cast("string"), 2, "0").alias("cents"),
        F.when(th > 0, F.concat(th.cast("string"), F.lit(","), rest)).otherwise(F.col("whole").cast("string"))
        .alias("us"),
        F.when(th > 0, F.concat(th.cast("string"), F.lit("."), rest)).otherwise(F.col("whole").cast("string"))
        .alias("eu"))
    plain, cents = F.col("plain"), F.col("cents")
    shapes = F.array(
        F.struct(F.lit("euro_us").alias("shape"), F.concat(F.lit("€ "), F.col("us"), F.lit("."), cents).alias("raw")),
        F.struct(F.lit("padded").alias("shape"), F.concat(F.lit(" "), plain, F.lit(" ")).alias("raw")),
        F.struct(F.lit("signed").alias("shape"), F.concat(F.lit("+"), plain).alias("raw")),
        F.struct(F.lit("euro_eu").alias("shape"), F.concat(F.lit("€ "), F.col("eu"), F.lit(","), cents).alias("raw")),
        F.struct(F.lit("suffix_d").alias("shape"), F.concat(plain, F.lit("d")).alias("raw")),
        F.struct(F.lit("spaced_sign").alias("shape"), F.concat(F.lit("- "), plain).alias("raw")),
        F.struct(F.lit("nbsp").alias("shape"), F.concat(F.lit("€\u00a0"), F.col("us"), F.lit("."), cents, F.lit("\u2009")).alias("raw")),
        F.struct(F.lit("overflow").alias("shape"), F.concat(F.col("plain"), F.lit("e999")).alias("raw")),
        F.struct(F.lit("percent").alias("shape"), F.concat(plain, F.lit("%")).alias("raw")),
    )
    return parts.select(F.explode(shapes).alias("s")).select("s.*")


def clean_currency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1/P2/P3 over every line price in every shape, totals per shape."""
    t = money_text(spark, sf_dir).select(
        "shape", clean_currency("raw").alias("us"), clean_currency("raw", decimal=",").alias("eu"),
        clean_percentage("raw").alias("pct"), clean_number("raw").alias("num"))

    return t.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"),
        xsum_cells("us").alias("total_us"), xsum_cells("eu").alias("total_eu"),
        xsum_cells("pct").alias("total_pct"), xsum_cells("num").alias("total_num"),
        F.count(F.when(F.col("us") == 0, 1)).alias("n_zero"),
    )


def weekly_text(spark: SparkSession, sf_dir: str, headers: tuple[str, ...] | None = None) -> DataFrame:
    """The weekly panel as a raw file: text cells under the original headers,
    every third week split into two rows, and one undated row per series."""
    wf = weekly_panel(spark, sf_dir, "segment")
    split = (F.col("iso_week") % 3 == 0)
    parts = wf.withColumn("part", F.explode(F.when(split, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    parts = parts.withColumn("week", F.concat(F.col("iso_year").cast("string"), _pad2(F.col("iso_week"))))
    undated = wf.groupBy("series_id").agg(*[F.max(c).alias(c) for c in BASE_MEASURES]).withColumns(
        {"part": F.lit(0), "week": F.lit(" ")})
    parts = parts.select("series_id", "week", "part", *BASE_MEASURES).unionByName(undated, allowMissingColumns=True)

    def cell(c: str) -> F.Column:
        if c in RATIO_MEASURES:  # a split week repeats its ratios
            text = F.col(c).cast("decimal(28,6)").cast("string")
            return F.concat(text, F.lit("%")) if c in PERCENT else text
        whole = F.col(c).cast("decimal(18,2)")
        first = F.floor(whole * 60).cast("decimal(20,0)") / 100 if c in MONEY else F.floor(whole * F.lit(0.6)).cast("decimal(20,0)")
        first = first.cast("decimal(18,2)")
        amount = F.when(F.col("part") == 0, whole).when(F.col("part") == 1, first).otherwise(whole - first)
        return F.concat(F.lit("€ "), F.format_number(amount, 2)) if c in MONEY else amount.cast("string")

    return parts.select(F.col("series_id").alias("Series"), F.col("week").alias("Year Week"),
                        *[cell(c).alias(h) for h, c in HEADER_MAP.items() if headers is None or h in headers])


def weekly_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, P1-P9 and the collapse of split weeks: the text must give the panel back."""
    return weekly_from_text(weekly_text(spark, sf_dir), series_col="Series")


BAD_FIELDS = 40


def weekly_csv(spark: SparkSession, sf_dir: str) -> str:
    """The weekly text as CSV files in the shared folder, among them one with malformed lines:
    per series one with two fields and one with ``BAD_FIELDS``."""
    text = weekly_text(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/panelcast-weekly-csv-{uuid.uuid4().hex}"
    text.write.csv(path, header=True)
    head = ",".join(f'"{c}"' for c in text.columns)
    series = text.select(F.col("Series").alias("s")).distinct()
    bad = series.select(F.explode(F.array(F.concat(F.col("s"), F.lit(",half a line")),
                                          F.concat("s", F.lit(",x" * (BAD_FIELDS - 1))))).alias("line"))
    # one row for one small file: two lines per series under the header
    bad.agg(F.concat(F.lit(f"{head}\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n"))).write.mode("append").text(path)
    return path


def weekly_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on real files: written, read back and cleaned, they must give the panel back."""
    return weekly_from_csv(spark, weekly_csv(spark, sf_dir), series_col="Series")


def weekly_csv_rejects_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every malformed line of those files, and no other."""
    return weekly_csv_rejects(spark, weekly_csv(spark, sf_dir))


def weekly_text_no_orders_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a file with the required columns only: orders fall back to sales / AOV."""
    return with_orders(weekly_from_text(weekly_text(spark, sf_dir, REQUIRED), series_col="Series")).select(
        "series_id", "week_start", "orders", "net_sales", "ad_spend", "mer", "op_profit", "aov")
