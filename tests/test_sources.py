"""Weekly CSV (S1/S2 + cleaning + duplicate weeks) and weather JSON."""

import datetime as dt
import json
import os
import tempfile

import pytest

from panelcast.operators import context
from panelcast.sources.weather import read_weather
from panelcast.sources.weekly_csv import read_weekly_csv, resolve_columns, weekly_from_csv

HEADER = ("Year Week,Cost,Amount Spent,Total sales,Returns,Discounts,Orders,Average order value,"
          "Returning customer rate,Conversions Value,Website Purchases Conversion Value,Avg. CPC,CPC (All),"
          "\"CPM (Cost per 1,000 Impressions)\",Frequency,Impressions,Items,Gross sales")


def _csv(rows):
    d = tempfile.mkdtemp(prefix="panelcast-csv-")
    p = os.path.join(d, "weekly.csv")
    with open(p, "w") as f:
        f.write(HEADER + "\n")
        for r in rows:
            f.write(r + "\n")
    return p


def test_weekly_csv_cleaning_and_duplicates(spark):
    p = _csv([
        '202401,"€ 1,200.50",850.00,15000.00,-120.00,-450.00,120,125.00,15%,5000,4000,0.85,0.9,12.5,1.2,48000,180,15450',
        '202401,100,50,1000,0,0,10,100,5%,100,100,1.0,1.0,10,1.0,1000,10,1000',
        '202402,abc,10,,,,,,,,,,,,,,,',
        '202153,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1',
        ',,,,,,,,,,,,,,,,,',
    ])
    df = weekly_from_csv(spark, p)
    rows = {r["week_start"]: r for r in df.collect()}
    assert set(rows) == {dt.date(2024, 1, 1), dt.date(2024, 1, 8)}
    w1 = rows[dt.date(2024, 1, 1)]
    assert w1["spend_a"] == pytest.approx(1300.5)      # duplicate week summed
    assert w1["total_sales"] == pytest.approx(16000.0)
    assert w1["returning_rate_pct"] == pytest.approx(10.0)   # ratio averaged
    assert w1["ad_spend"] == pytest.approx(2200.5)
    w2 = rows[dt.date(2024, 1, 8)]
    assert w2["spend_a"] == 0.0 and w2["total_sales"] == 0.0
    assert w2["mer"] == 0.0 and w2["roas_a"] is None


def test_missing_week_column_raises(spark):
    d = tempfile.mkdtemp(prefix="panelcast-csv-")
    p = os.path.join(d, "w.csv")
    with open(p, "w") as f:
        f.write("Cost,Amount Spent,Total sales\n1,2,3\n")
    with pytest.raises(ValueError):
        resolve_columns(read_weekly_csv(spark, p))


def test_absent_optional_columns_stay_null(spark):
    d = tempfile.mkdtemp(prefix="panelcast-csv-")
    p = os.path.join(d, "w.csv")
    with open(p, "w") as f:
        f.write(" Year Week ,Cost,Amount Spent,Total sales\n202401,10,10,290\n")
    r = weekly_from_csv(spark, p).first()
    assert r["orders"] is None and r["cpc_a"] is None
    assert r["mer"] == pytest.approx(14.5)
    assert r["op_profit"] is not None   # orders fall back to net sales / AOV


WEATHER = [
    {"city": "Milano", "lat": 45.46, "lon": 9.19,
     "daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [10.0, None],
               "precipitation_sum": [1.0, 3.0]}},
    {"city": "Roma", "lat": 41.9, "lon": 12.49,
     "daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [10.0, 14.0],
               "precipitation_sum": [0.0, 5.0]}},
]


def _weather(spark):
    d = tempfile.mkdtemp(prefix="panelcast-weather-")
    p = os.path.join(d, "w.json")
    with open(p, "w") as f:
        for rec in WEATHER:
            f.write(json.dumps(rec) + "\n")
    return read_weather(spark, p)


def test_weather_flatten_and_day(spark):
    w = _weather(spark)
    assert w.count() == 4
    day = {r["date"]: r for r in context.day_weather(w).collect()}
    d1, d2 = day[dt.date(2024, 1, 1)], day[dt.date(2024, 1, 2)]
    assert d1["hottest_city"] == "Milano"          # tie -> first city of the dimension
    assert d2["hottest_city"] == "Roma"            # NULL temperature ignored
    assert d2["avg_temp"] == pytest.approx(14.0)
    assert d2["max_rain"] == 5.0 and d2["total_rain"] == 8.0


def test_ledger_with_and_without_weather(spark):
    w = _weather(spark)
    df = spark.createDataFrame(
        [("ALL", dt.date(2024, 1, 1), 100.0, 50.0), ("ALL", dt.date(2023, 11, 6), 80.0, None)],
        "series_id string, week_start date, net_sales double, ad_spend double")
    led = {r["month"]: r for r in context.ledger(df, w).collect()}
    jan = led[dt.date(2024, 1, 1)]
    assert jan["avg_temp"] == pytest.approx(34.0 / 3) and jan["events"] == "Winter sales"
    nov = led[dt.date(2023, 11, 1)]
    assert nov["avg_temp"] == 15.0 and nov["avg_daily_rain_mm"] == 40.0 and nov["mer"] is None
    assert nov["events"] == "Black Friday"
    bod = context.business_on_day(df, context.day_weather(w)).collect()
    assert len(bod) == 1 and bod[0]["mer"] == 2.0


def test_bad_lines_are_rejected_and_none_is_lost(spark):
    from panelcast.sources.weekly_csv import weekly_csv_rejects

    good = "2024%02d,100,50,1000,0,0,10,100,5%%,100,100,1.0,1.0,10,1.0,1000,10,1000"
    bad = ["202409,1,2", "202410" + ",1" * 30, "only text"]
    lines = [good % k for k in range(1, 6)]
    p = _csv(lines[:2] + bad[:2] + lines[2:] + bad[2:] + [",,,,,,,,,,,,,,,,,"])
    rejects = weekly_csv_rejects(spark, p).collect()
    assert sorted(r.line for r in rejects) == sorted(bad) and {r.first_field for r in rejects} == {"202409", "202410", "only text"}
    assert read_weekly_csv(spark, p).count() == 5
    assert {r["week_start"] for r in weekly_from_csv(spark, p).collect()} == {dt.date(2024, 1, 1) + dt.timedelta(weeks=k) for k in range(5)}


def test_weather_text_with_gaps_and_no_records(spark):
    from panelcast.sources.weather import parse_weather

    record = json.dumps({"city": "X", "lat": 1.0, "lon": 2.0, "daily": {"time": ["2024-01-01", "2024-01-02"],
                         "temperature_2m_max": [None, 20.5], "precipitation_sum": [1.5, None]}})
    df = spark.createDataFrame([(record,), ("no json",), (None,), ("{}",)], "value string")
    rows = sorted(parse_weather(df).collect())
    assert [(r.date.isoformat(), r.temp, r.rain, r.band, r.marker_size) for r in rows] == [
        ("2024-01-01", None, 1.5, None, 6600.0), ("2024-01-02", 20.5, None, "warm", 6000.0)]
