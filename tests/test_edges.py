"""Odd inputs: a series without sales, negative totals, Unicode blanks, overflow, unknown segments, far years."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions.cleaning import clean_currency, clean_number, clean_percentage, parse_iso_week
from panelcast.operators import forecast as fc
from panelcast.operators import lfl, monthly, prepare, recent, scenario
from panelcast.session import checkpoint_dir
from panelcast.sources import calendar, tables


@pytest.fixture(scope="module")
def panel(spark):
    """Series without sales, with one week, with negative sales, and an ordinary one, over two years."""
    rows = []
    for k in range(104):
        week = dt.date(2023, 1, 2) + dt.timedelta(weeks=k)
        rows += [("zero", week, 0.0, 0.0, 0.0), ("minus", week, -50.0 - k, 10.0, 1.0), ("plain", week, 1000.0 + k, 100.0, 10.0)]
    rows.append(("one", dt.date(2024, 5, 6), 500.0, 50.0, 5.0))
    raw = spark.createDataFrame(rows, "series_id string, week_start date, total_sales double, spend_a double, orders double")
    raw = raw.withColumns({c: F.lit(0.0) for c in prepare.BASE_MEASURES if c not in raw.columns}).withColumns(
        {"iso_year": F.extract(F.lit("YEAROFWEEK"), "week_start").cast("int"), "iso_week": F.weekofyear("week_start"),
         "period_label": F.lit("")})
    return prepare.prepare(raw).cache()


@pytest.mark.parametrize("operator", [
    lambda x: monthly.monthly_ratios(monthly.monthly_fact(x)), monthly.health_score, recent.recent_kpis, recent.channel_signals,
    lfl.lfl_growth, lfl.lfl_elasticity, lfl.yoy_health, lfl.trailing_growth, lfl.suggested_saturation, scenario.seasonal_profile,
    scenario.project_baseline, fc.rf_features, lambda x: fc.driver_means(x, 4)])
def test_no_series_stops_the_others(panel, operator):
    out = operator(panel).collect()
    assert "plain" in {r.series_id for r in out}


def test_season_of_a_series_without_sales_is_null(panel):
    out = monthly.monthly_ratios(monthly.monthly_fact(panel))
    assert {r.seasonality for r in out.filter("series_id = 'zero'").collect()} == {None}
    assert {r.season for r in monthly.health_score(panel).filter("series_id = 'zero'").collect()} == {"standard"}


@pytest.mark.parametrize("rf, additive, verdict", [
    (100.0, 95.0, "high"), (100.0, 80.0, "moderate"), (100.0, 0.0, "divergent"), (100.0, -50.0, "divergent"), (-10.0, -11.0, "divergent")])
def test_consensus_needs_positive_totals(spark, rf, additive, verdict):
    ens = spark.createDataFrame([("s", "base", rf, additive)], "series_id string, scenario_id string, pred_rf double, pred_additive double")
    assert fc.consensus(ens).first().consensus == verdict


@pytest.mark.parametrize("text, want", [
    ("€ 1,200.50", 1200.5), ("1,200.50 €", 1200.5), ("5 ", 5.0), ("　\x1f7 ", 7.0), ("1e999", 0.0), ("-1e999", 0.0), ("1e308", 1e308)])
def test_money_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_currency("t")).first()[0] == want
    if "€" not in text:
        assert df.select(clean_number("t")).first()[0] == want
        assert df.select(clean_percentage(F.concat("t", F.lit("%")))).first()[0] == want


def test_padded_week(spark):
    df = spark.createDataFrame([("202501 ",), (" 202501",)], "t string")
    assert {r[0] for r in df.select(parse_iso_week("t")).collect()} == {dt.date(2024, 12, 30)}


def test_rates_keep_their_decimals(spark):
    cols = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    out = tables.line_totals(spark.createDataFrame([(1, 1.0, 100.0, 0.0825, 0.125, "N", "O")], cols)).first()
    assert float(out.disc) == pytest.approx(2.7 * 8.25) and float(out.tax_a) == pytest.approx(12.5)


@pytest.mark.parametrize("column, value", [("l_discount", 1 / 3), ("l_tax", 0.0000001), ("l_extendedprice", 10.005), ("l_extendedprice", 1e17)])
def test_digits_that_do_not_fit_fail_instead_of_being_rounded(spark, column, value):
    row = {"l_orderkey": 1, "l_quantity": 1.0, "l_extendedprice": 100.0, "l_discount": 0.1, "l_tax": 0.1, "l_returnflag": "N", "l_linestatus": "O"}
    cols = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    with pytest.raises(Exception, match=f"{column} does not fit"):
        tables.line_totals(spark.createDataFrame([tuple({**row, column: value}.values())], cols)).collect()
    noise = tables.line_totals(spark.createDataFrame([tuple({**row, "l_discount": 0.1 + 0.2, "l_tax": None}.values())], cols)).first()
    assert float(noise.disc) == pytest.approx(81.0) and noise.tax_a is None


def test_unknown_segment_is_named_or_defaulted(spark):
    df = spark.createDataFrame([("BUILDING",), ("SPACE",)], "s string")
    assert [r[0] for r in df.select(tables.spend_multiplier("s", default=1)).collect()] == [7, 1]
    with pytest.raises(Exception, match="no spend multiplier for segment SPACE"):
        df.select(tables.spend_multiplier("s")).collect()


@pytest.mark.parametrize("year, easter", [(1985, (4, 7)), (2008, (3, 23)), (2038, (4, 25)), (2045, (4, 9))])
def test_holidays_of_any_year(spark, year, easter):
    df = spark.range(1).select(F.lit(year).alias("y"))
    assert df.select(calendar.easter_sunday(F.col("y"))).first()[0] == dt.date(year, *easter)
    first = dt.date(year, 1, 4) - dt.timedelta(days=dt.date(year, 1, 4).weekday())
    weeks = spark.createDataFrame([(first + dt.timedelta(weeks=k),) for k in range(52)], "week_start date")
    out = weeks.select("week_start", *[v.alias(k) for k, v in calendar.holidays_in_week(F.col("week_start")).items()]).collect()
    for name in ("holiday_christmas_day", "holiday_easter_sunday", "holiday_republic_day"):
        assert sum(r[name] for r in out) == 1
    christmas = next(r.week_start for r in out if r.holiday_christmas_day)
    assert 0 <= (dt.date(year, 12, 25) - christmas).days < 7


def test_a_holiday_has_its_own_effect(spark):
    weeks = [dt.date(2015, 1, 5) + dt.timedelta(weeks=k) for k in range(52 * 8)]
    day = lambda w, month, d: any((w + dt.timedelta(days=i)).timetuple()[1:3] == (month, d) for i in range(7))
    rows = [("s", w, 1000.0 + 400.0 * day(w, 12, 25)) for w in weeks]
    df = spark.createDataFrame(rows, "series_id string, week_start date, y double").withColumns({c: F.lit(0.0) for c in fc.REG_COLS})
    pdf = fc.additive_design(spark, df).toPandas().sort_values("week_start").reset_index(drop=True)
    yhat, _, _ = fc._fit_predict(pdf.iloc[:-60], pdf.iloc[-60:])
    got = dict(zip(pdf["week_start"].iloc[-60:], yhat))
    peak, june = next(w for w in got if day(w, 12, 25)), next(w for w in got if day(w, 6, 2))
    assert got[peak] == pytest.approx(1400, rel=0.05) and got[june] == pytest.approx(1000, rel=0.05)


def test_shared_folder_is_required_off_a_local_master(spark):
    class Remote:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Remote()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
