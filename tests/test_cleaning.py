"""Edge rows of the cleaning expressions (FIXTURES F-1)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions import cleaning as C


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_clean_currency_us(spark):
    vals = ["€ 1,200.50", " 5 ", "+5", "1e3", "", None, "None", "- 5", "1.200.50", "€ 1.200,50", "1.0d", "1_000"]
    assert _eval(spark, vals, C.clean_currency) == [1200.5, 5.0, 5.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.2005, 0.0, 0.0]


def test_clean_currency_decimal_comma(spark):
    assert _eval(spark, ["€ 1.200,50", "850,00"], lambda c: C.clean_currency(c, decimal=",")) == [1200.5, 850.0]


def test_clean_percentage(spark):
    assert _eval(spark, ["15%", " 15 % ", "0.15", "x", None], C.clean_percentage) == [15.0, 15.0, 0.15, 0.0, 0.0]


def test_clean_number(spark):
    assert _eval(spark, ["120", " 7.5 ", "abc", None], C.clean_number) == [120.0, 7.5, 0.0, 0.0]


def test_parse_iso_week(spark):
    vals = ["202501", "202053", "202153", "202400", "20251", "2025-01", "202501.0", None, " 202501 "]
    got = _eval(spark, vals, C.parse_iso_week)
    assert got == [dt.date(2024, 12, 30), dt.date(2020, 12, 28), None, None, None, None, None, None,
                   dt.date(2024, 12, 30)]


@pytest.mark.parametrize("year", [2015, 2020, 2021, 2024, 2026])
def test_parse_iso_week_matches_python(spark, year):
    weeks = [f"{year}{w:02d}" for w in range(1, 54)]
    got = _eval(spark, weeks, C.parse_iso_week)
    for w, g in zip(range(1, 54), got):
        try:
            exp = dt.date.fromisocalendar(year, w, 1)
        except ValueError:
            exp = None
        assert g == exp


def test_week_label(spark):
    got = _eval(spark, [dt.date(2024, 12, 30), None], C.week_range_label, "date")
    assert got == ["30 Dec - 05 Jan 2025", ""]


def test_iso_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    r = df.select(C.iso_year("d"), C.iso_week("d")).first()
    assert (r[0], r[1]) == (2025, 1)


def test_weather_band_and_money(spark):
    assert _eval(spark, [0.0, 5.0, 12.0, 20.0, 28.0, None], C.weather_band, "double") == \
        ["freezing", "cold", "mild", "warm", "hot", None]
    assert _eval(spark, [2_500_000.0, 45_000.0], C.compact_money, "double") == ["€ 2.5M", "€ 45k"]


def test_sums_of_cells_are_the_exact_sums(spark):
    from panelcast.functions.exact import xsum, xsum_cells

    values = [None, 0.0, -0.0, 1234.56, -1234.56, 0.1 + 0.2, 5e-7, -5e-7, 1.0000005, 123456789.123456, 1e15 + 0.25, -3e15,
              987654321.987654, 1e20, 33554431.999999, -33554432.000001]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values * 4)] + [(9, None)], "g int, v double")
    for x in (df, *(df.filter(df.v == v) for v in values if v is not None)):
        for r in x.groupBy("g").agg(xsum("v").alias("want"), xsum_cells("v").alias("got")).collect():
            assert r.got == r.want, r


def test_blanks_of_any_kind_are_trimmed(spark):
    cells = [f"{a}1,5{b}" for a in ("", " ", "\t", "\xa0 \t", "€ ", "€ ") for b in ("", "\n ", " 　", "€", "d")]
    want = [0.0 if c.endswith("d") else 1.5 for c in cells]
    assert _eval(spark, cells, lambda c: C.clean_currency(c, decimal=",")) == want
