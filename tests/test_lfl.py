"""LFL growth / elasticity on literal frames + metamorphic checks."""

import datetime as dt

import pytest

from panelcast.functions.cleaning import iso_week, iso_year
from panelcast.operators import lfl, recent


def _weekly(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, week_start date, net_sales double, ad_spend double")
    return df.withColumns({"iso_year": iso_year("week_start"), "iso_week": iso_week("week_start")})


def _weeks(year, weeks, sales, spend, sid="S"):
    return [(sid, dt.date.fromisocalendar(year, w, 1), sales, spend) for w in weeks]


def test_lfl_growth_common_weeks(spark):
    rows = _weeks(2022, range(1, 53), 100.0, 10.0) + _weeks(2023, range(1, 11), 150.0, 30.0)
    g = lfl.lfl_growth(_weekly(spark, rows)).first()
    assert (g["year"], g["prev_year"], g["n_common_weeks"]) == (2023, 2022, 10)
    assert g["growth"] == pytest.approx(0.5) and g["is_partial"] is True
    e = lfl.lfl_elasticity(_weekly(spark, rows)).first()
    assert e["delta_spend_pct"] == pytest.approx(200.0)
    assert e["elasticity"] == pytest.approx(0.25)


def test_lfl_whole_year_fallback(spark):
    rows = _weeks(2022, [1, 2], 100.0, 1.0) + _weeks(2023, [30, 31], 300.0, 1.0)
    g = lfl.lfl_growth(_weekly(spark, rows)).first()
    assert g["basis"] == "whole_year" and g["growth"] == pytest.approx(2.0)
    assert lfl.lfl_elasticity(_weekly(spark, rows)).count() == 0


def test_duplicate_series_is_independent(spark):
    base = _weeks(2022, range(1, 20), 100.0, 10.0) + _weeks(2023, range(1, 20), 120.0, 11.0)
    twin = [("T",) + r[1:] for r in base]
    one = {(r.series_id, r.year): r.growth for r in lfl.lfl_growth(_weekly(spark, base)).collect()}
    both = {(r.series_id, r.year): r.growth for r in lfl.lfl_growth(_weekly(spark, base + twin)).collect()}
    assert both[("S", 2023)] == one[("S", 2023)] == both[("T", 2023)]


def test_trailing_growth(spark):
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(weeks=i), 100.0 if i < 52 else 200.0, 1.0) for i in range(104)]
    t = lfl.trailing_growth(_weekly(spark, rows)).first()
    assert t["growth_rate"] == pytest.approx(1.0)


def test_suggested_saturation_clips(spark):
    rows = _weeks(2022, range(1, 53), 100.0, 10.0) + _weeks(2023, range(1, 53), 300.0, 20.0)
    s = lfl.suggested_saturation(_weekly(spark, rows)).first()
    assert s["saturation"] == 1.0
    rows = _weeks(2022, range(1, 53), 100.0, 10.0) + _weeks(2023, range(1, 53), 100.0, 10.0)
    assert lfl.suggested_saturation(_weekly(spark, rows)).first()["saturation"] == 0.85


def test_recent_kpis_short_series(spark):
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(weeks=i), 100.0, 10.0) for i in range(6)]
    df = _weekly(spark, rows).withColumns({"op_profit": recent.F.lit(5.0), "orders": recent.F.lit(2.0),
                                           "discounts": recent.F.lit(-1.0),
                                           "period_label": recent.F.lit("x")})
    k = recent.recent_kpis(df).first()
    assert k["sales"] == 400.0 and k["mer"] == 10.0
    assert k["d_sales"] is None and k["d_mer"] is None
    assert k["season_context"] == "winter_sales"


def test_year_pairs_adjacent_available(spark):
    rows = _weeks(2019, [1], 1.0, 1.0) + _weeks(2021, [1], 1.0, 1.0) + _weeks(2022, [1], 1.0, 1.0)
    got = sorted((r.year, r.prev_year) for r in lfl.year_pairs(_weekly(spark, rows)).collect())
    assert got == [(2021, 2019), (2022, 2021)]
    common = sorted((r.year, r.prev_year, r.iso_week) for r in lfl.common_weeks(_weekly(spark, rows)).collect())
    assert common == [(2021, 2019, 1), (2022, 2021, 1)]


def test_growth_and_saturation_together(spark):
    """One pass gives what the two operators give, and moves the rows once."""
    from conftest import SF001
    from panelcast.operators import lfl
    from panelcast.operators.prepare import weekly_panel

    wf = weekly_panel(spark, SF001, "nation")
    both = lfl.growth_and_saturation(wf)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    growth = {r.series_id: (r.last_week, r.growth_rate) for r in lfl.trailing_growth(wf).collect()}
    saturation = {r.series_id: r.saturation for r in lfl.suggested_saturation(wf).collect()}
    rows = both.collect()
    assert len(rows) == len(growth) > 20
    assert all((r.last_week, r.growth_rate) == growth[r.series_id] and r.saturation == saturation[r.series_id] for r in rows)
