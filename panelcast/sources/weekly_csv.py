"""S1 + S2: raw weekly CSV -> canonical weekly fact.

Everything is read as text (no schema inference, so a blank row cannot turn
the week column into floats), header blanks are stripped, all-empty rows are
dropped, and columns are resolved through an explicit ordered mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import (clean_currency, clean_number, clean_percentage, iso_week, iso_year,
                                  parse_iso_week, week_range_label)
from ..functions.economics import TABLE_ECONOMICS, Economics
from ..operators.prepare import BASE_MEASURES, collapse_duplicate_weeks, derive_metrics, drop_undated, fill_zero

# Input header -> canonical column (the weekly file contract).
DATE_TOKENS = ("Year Week", "Settimana")
HEADER_MAP = {
    "Cost": "spend_a",
    "Amount Spent": "spend_b",
    "Total sales": "total_sales",
    "Returns": "returns",
    "Orders": "orders",
    "Average order value": "aov",
    "Gross sales": "gross_sales",
    "Discounts": "discounts",
    "Conversions Value": "conv_value_a",
    "Website Purchases Conversion Value": "conv_value_b",
    "Avg. CPC": "cpc_a",
    "CPC (All)": "cpc_b",
    "CPM (Cost per 1,000 Impressions)": "cpm_b",
    "Impressions": "impressions_a",
    "Frequency": "frequency_b",
    "Items": "items",
    "Returning customer rate": "returning_rate_pct",
    "sessions": "sessions",
}
REQUIRED = ("Cost", "Amount Spent", "Total sales")
MONEY = ("spend_a", "spend_b", "total_sales", "returns", "aov", "gross_sales", "discounts", "conv_value_a",
         "conv_value_b", "cpc_a", "cpc_b", "cpm_b")
NUMBERS = ("impressions_a", "frequency_b", "items", "orders", "sessions")
PERCENT = ("returning_rate_pct",)


REJECTED = "_rejected"


def _read_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Every line of the file(s) as strings under stripped headers; a line with too many or
    too few fields is kept whole in ``REJECTED``."""
    header = spark.read.csv(path, header=True, sep=sep, inferSchema=False).schema
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(REJECTED, T.StringType())])
    # without pruning a line's fields are counted whatever columns a query asks for
    raw = spark.read.schema(schema).option("columnPruning", "false").csv(
        path, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, enforceSchema=True)
    return raw.toDF(*[f.name.strip() for f in header], REJECTED)


def read_weekly_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV as strings, stripped headers; rejected lines and all-empty rows dropped.

    ``path`` is a file or a folder of files with one header each.  What is dropped as
    malformed is what :func:`weekly_csv_rejects` lists.
    """
    raw = _read_lines(spark, path, sep)
    raw = raw.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    # drop rows where every field is empty (headers may hold dots: quote them)
    return raw.filter(F.coalesce(*[F.col(f"`{c}`") for c in raw.columns]).isNotNull())


def weekly_csv_rejects(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(first_field, line): each line with too many or too few fields, as it stands in the file."""
    raw = _read_lines(spark, path, sep)
    return raw.filter(F.col(REJECTED).isNotNull()).select(F.col(f"`{raw.columns[0]}`").alias("first_field"), F.col(REJECTED).alias("line"))


def resolve_columns(df: DataFrame, series_id: str | None = "ALL", series_col: str | None = None,
                    mapping: dict | None = None, decimal: str = ".") -> tuple[DataFrame, list[str]]:
    """S2 + P1-P4, P6, P7: canonical columns from raw headers.

    The week column is the first header containing a date token; missing
    required columns or a missing week column raise.  Optional columns that
    are absent become typed NULL and are reported as not present (P8 leaves
    them NULL).
    """
    mapping = mapping or HEADER_MAP
    date_col = next((c for c in df.columns if any(t in c for t in DATE_TOKENS)), None)
    if date_col is None:
        raise ValueError("weekly file has no week column ('Year Week')")
    missing = [h for h in REQUIRED if h not in df.columns]
    if missing:
        raise ValueError(f"weekly file lacks required columns: {missing}")
    # positional aliases: headers may hold dots, commas or parentheses
    pos = {h: f"_c{i}" for i, h in enumerate(df.columns)}
    df = df.toDF(*[pos[h] for h in df.columns])
    sel = [parse_iso_week(F.col(pos[date_col])).alias("week_start")]
    sel.append((F.col(pos[series_col]) if series_col else F.lit(series_id)).cast("string").alias("series_id"))
    present = []
    for header, canon in mapping.items():
        if header in pos:
            c = F.col(pos[header])
            if canon in MONEY:
                expr = clean_currency(c, decimal=decimal)
            elif canon in PERCENT:
                expr = clean_percentage(c)
            else:
                expr = clean_number(c)
            present.append(canon)
        else:
            expr = F.lit(None).cast("double")
        sel.append(expr.alias(canon))
    return df.select(*sel), present


def weekly_from_csv(spark: SparkSession, path: str, sep: str = ",", econ: Economics = TABLE_ECONOMICS,
                    **kw) -> DataFrame:
    """S1 -> S2 -> P5 -> duplicate-week collapse -> P8 -> P9."""
    return weekly_from_text(read_weekly_csv(spark, path, sep), econ, **kw)


def weekly_from_text(raw: DataFrame, econ: Economics = TABLE_ECONOMICS, **kw) -> DataFrame:
    """The same from text columns with the original headers, wherever they come from."""
    df, present = resolve_columns(raw, **kw)
    df = collapse_duplicate_weeks(drop_undated(df))
    df = df.withColumns({"iso_year": iso_year("week_start"), "iso_week": iso_week("week_start"),
                         "period_label": week_range_label("week_start")})
    df = fill_zero(df, present)
    cols = ["series_id", "week_start", "iso_year", "iso_week", "period_label", *BASE_MEASURES]
    return derive_metrics(df.select(*cols), econ)
