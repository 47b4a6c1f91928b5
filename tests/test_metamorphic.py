"""Metamorphic checks: scale 1 => boost 1, x^sat at x=1 is 1, input order
does not matter, a CSV-built panel flows through the analysis operators."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelcast.functions.economics import Scenario
from panelcast.operators import lfl, monthly, recent, scenario
from panelcast.operators.prepare import weekly_panel
from panelcast.sources.weekly_csv import weekly_from_csv


@pytest.fixture(scope="module")
def panel(spark):
    return weekly_panel(spark, SF001)


def test_unit_scales_give_unit_boost(panel):
    scen = (Scenario("unit", 0.0, 1.0, 1.0, 0.85, 6, 0.0, 0.0), Scenario("double", 0.0, 2.0, 2.0, 0.85, 6, 0.0, 0.0))
    p = scenario.project_baseline(panel, scen)
    grid = scenario.seasonal_lookup(scenario.scenario_grid(panel, scen), scenario.seasonal_profile(panel))
    base = grid.filter("scenario_id = 'unit'").select(
        "series_id", "step", (F.col("base_net_sales") * (1 + F.col("growth_rate"))).alias("expected"))
    j = p.filter("scenario_id = 'unit'").join(base, ["series_id", "step"])
    assert j.filter(F.abs(F.col("sales") - F.col("expected")) > 1e-6 * F.abs(F.col("expected"))).count() == 0
    # doubling both budgets raises sales by less than double (saturation)
    u = {(r.series_id, r.step): r.sales for r in p.filter("scenario_id = 'unit'").collect()}
    d = {(r.series_id, r.step): r.sales for r in p.filter("scenario_id = 'double'").collect()}
    assert all(u[k] < d[k] < 2 * u[k] for k in u if u[k] > 0)
    assert p.groupBy("series_id", "scenario_id").count().filter("count != 26").count() == 0


def test_saturation_curve_endpoints(panel):
    c = scenario.saturation_curve(panel).collect()
    for r in c:
        if r.i == 0:
            assert r.x == 1.0 and r.y == 1.0
        if r.i == 19:
            assert r.x == pytest.approx(4.0) and r.y == pytest.approx(4.0 ** r.saturation)


def test_shuffled_input_same_output(spark, panel):
    shuffled = panel.orderBy(F.rand(3)).repartition(7)
    for op in (lfl.lfl_growth, lfl.yoy_health, recent.recent_kpis, monthly.health_score):
        a = sorted(tuple(r) for r in op(panel).collect())
        b = sorted(tuple(r) for r in op(shuffled).collect())
        assert a == b, op.__name__


def test_csv_panel_through_operators(spark):
    d = tempfile.mkdtemp(prefix="panelcast-csv-")
    p = os.path.join(d, "w.csv")
    rows = ["Year Week,Cost,Amount Spent,Total sales,Returns,Discounts,Orders,Gross sales,Conversions Value,"
            "Website Purchases Conversion Value,Returning customer rate"]
    start = dt.date(2022, 1, 3)
    for i in range(110):
        y, w, _ = (start + dt.timedelta(weeks=i)).isocalendar()
        rows.append(f"{y}{w:02d},{100 + i},{50 + i},{2000 + 10 * i},-{20 + i},-{100 + i},{20 + i % 5},"
                    f"{2300 + 10 * i},{600 + i},{500 + i},{10 + i % 3}%")
    with open(p, "w") as f:
        f.write("\n".join(rows) + "\n")
    wf = weekly_from_csv(spark, p)
    assert wf.count() == 110
    k = recent.recent_kpis(wf).first()
    assert k["n_rows"] == 110 and k["d_sales"] is not None
    g = lfl.lfl_growth(wf).collect()
    assert {(r.year, r.prev_year) for r in g} == {(2023, 2022), (2024, 2023)}
    assert monthly.health_score(wf).count() == 12
