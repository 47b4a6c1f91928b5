"""The weekly rollup over lines: equal to the rollup over per-order totals, and no wide sums per order or customer."""
import datetime as dt
import re

import pytest

from panelcast.sources import tables
from panelcast.sources.incremental import IncrementalPanel


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rollup"))
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    write = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{at}/{name}.parquet")
    write("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")
    write("customer", [(k, k % 2, ["BUILDING", "MACHINERY"][k % 2]) for k in range(6)] + [(5, 0, "BUILDING")],
          "c_custkey long, c_nationkey int, c_mktsegment string")
    orders = [(k, k % 7, day(k % 20) if k % 11 else None, ["1-URGENT", "5-LOW", None][k % 3]) for k in range(60)]
    write("orders", orders + orders[:5] + [(None, 1, day(1), "5-LOW"), (3, None, day(1), "5-LOW")],
          "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    lines = [(k % 50, 1.0 + k % 4, 100.25 + k, 0.0825 if k % 5 else None, 0.125 if k % 7 else None,
              ["R", "N", None][k % 3], ["O", "F", None, "F"][k % 4]) for k in range(300)]
    write("lineitem", lines + lines[:9] + [(None, 1.0, 5.0, 0.0, 0.0, "R", "F")],
          "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    write("events", [(1, day(3)), (2, day(3)), (1, day(9))], "user_id long, ts timestamp")
    return at


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("grain", tables.GRAINS)
def test_lines_give_what_their_totals_per_order_give(spark, folder, grain):
    got = tables.weekly_rollup(spark, folder, grain)
    want = tables.weekly_rollup(spark, folder, grain, lines=tables.order_line_totals(spark, folder))
    assert got.schema == want.schema and rows(got) == rows(want)
    assert got.filter("week_start is null").count() > 0 and got.filter("returns > 0").isEmpty()


def test_customers_with_finished_lines_count_once_a_week(spark, folder):
    """frequency_b is finished lines per distinct customer who has any."""
    lines = {}
    for x in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        lines[x.l_orderkey] = lines.get(x.l_orderkey, 0) + (x.l_linestatus == "F")
    segments = {}
    for c in spark.read.parquet(f"{folder}/customer.parquet").collect():
        segments.setdefault(c.c_custkey, []).append(c.c_mktsegment)
    n, who = {}, {}
    for o in spark.read.parquet(f"{folder}/orders.parquet").collect():
        for s in segments.get(o.o_custkey, []) if o.o_orderkey is not None and lines.get(o.o_orderkey) else []:
            week = o.o_orderdate and (o.o_orderdate - dt.timedelta(days=o.o_orderdate.weekday())).date()
            n[s, week] = n.get((s, week), 0) + lines[o.o_orderkey]
            who.setdefault((s, week), set()).add(o.o_custkey)
    got = {(r.series_id, r.week_start): r.frequency_b for r in tables.weekly_rollup(spark, folder).collect() if r.frequency_b}
    assert got == {k: pytest.approx(n[k] * 0.6 / len(who[k]), abs=1e-6) for k in n}


def wide(plan):
    """Aggregates of the plan that hold sums per order or per customer."""
    found = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[([^\]]*)", plan._jdf.queryExecution().executedPlan().toString())
    assert found
    return [(k, f) for k, f in found if re.search("orderkey|custkey", k) and re.search(r"sum\(", f)]


def test_no_wide_sums_per_order_or_customer(spark, folder):
    assert wide(tables.weekly_rollup(spark, folder)) == []


def test_states_are_summed_by_week_alone(spark, folder, tmp_path):
    panel = IncrementalPanel(spark, folder, str(tmp_path / "states"))
    assert rows(panel.refresh().panel.select("series_id", "week_start", "total_sales", "spend_b", "frequency_b")) == rows(
        tables.weekly_rollup(spark, folder).filter("week_start is not null").na.fill(0.0).select(
            "series_id", "week_start", "total_sales", "spend_b", "frequency_b"))
    assert wide(panel._fact(panel.store.manifest(), [2024])) == []


def test_customer_rows_are_dealt_by_series_once(spark, folder):
    """Above the narrow rows of lines, orders and sessions no wide week is shuffled or joined, and the rows are the same."""
    from panelcast.operators import prepare

    fact = prepare.weekly_fact(spark, folder, "customer")
    plan = fact._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Union")]
    assert "Join" not in above and "Exchange" not in above
    joined = prepare.with_sessions(spark, folder, tables.weekly_rollup(spark, folder, "customer"), "customer")
    want = prepare.derive_metrics(prepare.fill_zero(joined))
    assert fact.schema == want.schema and rows(fact) == rows(want)
    assert not fact.filter("sessions > 0").isEmpty() and not fact.filter("week_start is null").isEmpty()


def test_a_bucketed_panel_has_a_file_a_bucket(spark, folder):
    from panelcast.operators import prepare

    panel = prepare.weekly_panel(spark, folder, "customer")
    assert 0 < len(panel.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
