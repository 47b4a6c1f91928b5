"""The incremental panel: the same fact as one pass, only changed files read, only their years written."""

import datetime as dt
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelcast.operators.prepare import weekly_fact
from panelcast.sources.incremental import IncrementalPanel

DIMENSIONS = ("customer", "nation", "events")


@pytest.fixture
def shop(spark):
    """A folder of tables whose lines and orders come in files by order date; adds one file at a time."""
    class Shop:
        dir = tempfile.mkdtemp(prefix="panelcast-shop-")

        def add(self, table, name, df):
            os.makedirs(f"{self.dir}/{table}.parquet", exist_ok=True)
            out = tempfile.mkdtemp(prefix="panelcast-part-")
            df.coalesce(1).write.mode("overwrite").parquet(out)
            part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
            shutil.copy(f"{out}/{part}", f"{self.dir}/{table}.parquet/{name}.parquet")

        def path(self, table, name):
            return f"{self.dir}/{table}.parquet/{name}.parquet"

    s = Shop()
    for t in DIMENSIONS:
        shutil.copy(f"{SF001}/{t}.parquet", f"{s.dir}/{t}.parquet")
    s.orders = spark.read.parquet(f"{SF001}/orders.parquet").cache()
    s.lines = spark.read.parquet(f"{SF001}/lineitem.parquet").cache()
    s.state = tempfile.mkdtemp(prefix="panelcast-states-")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def same_as_one_pass(spark, shop, got):
    want = weekly_fact(spark, shop.dir)
    assert got.panel.dtypes == want.dtypes
    assert rows(got.panel) == rows(want)


def until(shop, year):
    return shop.orders.filter(F.year("o_orderdate") < year), shop.lines.join(
        shop.orders.filter(F.year("o_orderdate") < year), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


def spoil(path):
    """Make a file unreadable, with the size and time it had."""
    was = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"spoiled!" * (was.st_size // 8))
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


def test_a_new_file_is_all_that_is_read(spark, shop):
    orders, lines = until(shop, 2001)
    shop.add("orders", "old", orders)
    shop.add("lineitem", "old", lines)
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    first = panel.refresh()
    same_as_one_pass(spark, shop, first)
    assert len(first.read) == 2 and len(first.years) > 4

    again = IncrementalPanel(spark, shop.dir, shop.state).refresh()
    assert again.read == [] and again.years == [] and rows(again.panel) == rows(first.panel)

    shop.add("orders", "new", shop.orders.exceptAll(orders))
    shop.add("lineitem", "new", shop.lines.exceptAll(lines))
    good = {k: open(shop.path(t, "old"), "rb").read() for k, t in enumerate(("orders", "lineitem"))}
    for t in ("orders", "lineitem"):
        spoil(shop.path(t, "old"))
    got = panel.refresh()
    result = rows(got.panel)
    assert [p.rpartition("/")[2] for p in got.read] == ["new.parquet", "new.parquet"]
    assert set(got.years) <= {2000, 2001} and 2001 in got.years
    for k, t in enumerate(("orders", "lineitem")):
        with open(shop.path(t, "old"), "wb") as f:
            f.write(good[k])
    assert result == rows(weekly_fact(spark, shop.dir))


def test_lines_of_one_order_in_several_files(spark, shop):
    shop.add("orders", "all", shop.orders)
    odd = F.col("l_linenumber") % 2 == 1
    shop.add("lineitem", "odd", shop.lines.filter(odd))
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    same_as_one_pass(spark, shop, panel.refresh())
    shop.add("lineitem", "even", shop.lines.filter(~odd))
    same_as_one_pass(spark, shop, panel.refresh())


def test_lines_that_come_before_their_orders_wait(spark, shop):
    early, _ = until(shop, 1998)
    shop.add("lineitem", "all", shop.lines)
    shop.add("orders", "early", early)
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    same_as_one_pass(spark, shop, panel.refresh())
    shop.add("orders", "late", shop.orders.exceptAll(early))
    got = panel.refresh()
    same_as_one_pass(spark, shop, got)
    assert [p.rpartition("/")[2] for p in got.read] == ["late.parquet"] and min(got.years) >= 1997


def test_changed_and_removed_files(spark, shop):
    orders, lines = until(shop, 2000)
    shop.add("orders", "old", orders)
    shop.add("orders", "new", shop.orders.exceptAll(orders))
    shop.add("lineitem", "old", lines)
    shop.add("lineitem", "new", shop.lines.exceptAll(lines))
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    same_as_one_pass(spark, shop, panel.refresh())

    shop.add("lineitem", "new", shop.lines.exceptAll(lines).filter("l_quantity > 10"))  # changed
    got = panel.refresh()
    assert len(got.read) == 1 and min(got.years) >= 1999
    same_as_one_pass(spark, shop, got)

    os.remove(shop.path("lineitem", "new"))
    got = panel.refresh()
    assert got.read == [] and max(r.week_start for r in got.panel.collect()) < dt.date(2000, 1, 8)
    same_as_one_pass(spark, shop, got)

    shop.add("orders", "old", orders.filter("o_orderkey % 3 <> 0"))  # changed orders: lines are placed anew
    got = panel.refresh()
    assert len(got.read) == 1
    same_as_one_pass(spark, shop, got)


def test_a_changed_dimension_reads_no_line(spark, shop):
    shop.add("orders", "all", shop.orders)
    shop.add("lineitem", "all", shop.lines)
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    panel.refresh()
    moved = spark.read.parquet(f"{SF001}/customer.parquet").withColumn("c_mktsegment", F.lit("BUILDING"))
    os.remove(f"{shop.dir}/customer.parquet")
    shop.add("customer", "all", moved)
    got = panel.refresh()
    assert got.read == [] and {r.series_id for r in got.panel.collect()} == {"BUILDING"}
    same_as_one_pass(spark, shop, got)


def test_a_refresh_that_died_is_made_good(spark, shop, monkeypatch):
    orders, lines = until(shop, 2001)
    shop.add("orders", "old", orders)
    shop.add("lineitem", "old", lines)
    panel = IncrementalPanel(spark, shop.dir, shop.state)
    panel.refresh()
    shop.add("orders", "new", shop.orders.exceptAll(orders))
    shop.add("lineitem", "new", shop.lines.exceptAll(lines))
    with monkeypatch.context() as m:
        def die(self, manifest):
            raise RuntimeError("lost")

        m.setattr(IncrementalPanel, "_write_years", die)
        with pytest.raises(RuntimeError):
            panel.refresh()
    got = panel.refresh()
    assert got.read == [] and 2001 in got.years
    same_as_one_pass(spark, shop, got)


def test_no_files(spark, shop):
    got = IncrementalPanel(spark, shop.dir, shop.state).refresh()
    assert got.panel.count() == 0 and got.years == [] and "sessions" in got.panel.columns
