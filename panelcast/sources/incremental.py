"""S7 kept up to date: the weekly panel from mergeable states of its source files.

Order lines and orders arrive as files.  A refresh reads the files that are new or
changed, and no other: their lines become one row per (file, order) with the order's
week and customer, stored by ISO year.  Sums of money are exact decimals, so the
states of any number of files merge into the same totals as one pass over all of
them.  Only the ISO years that the changed files touch are rolled up again, from
the states, and overwritten in the panel.

A folder that all executors share holds everything::

    lines/batch=B/iso_year=Y   order totals of the files of one refresh (Y = 0: order not seen yet)
    orders/batch=B             orders of the files of one refresh
    panel/iso_year=Y           the weekly fact
    manifest.json              files, their states, and the years due to be written

What counts is what the manifest names, and it is replaced in one step before and
after the panel is written: a refresh that dies leaves states that nobody reads, or
years that the next refresh writes again.  One refresh at a time may run on a folder.

* Lines whose order is in no file yet wait in year 0 and are placed when it comes.
* A changed or removed file of lines: its rows no longer count, its years are due.
* A changed or removed file of orders: all lines are placed anew, from their states.
* A changed customer, nation or events table: all years are due, no line is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import iso_year
from ..functions.economics import TABLE_ECONOMICS, Economics
from ..operators.prepare import derive_metrics, fill_zero, table_files, with_sessions
from ..session import discard
from .tables import (RETURNING_PRIORITY, SEGMENT_K, line_rows, order_sums, series_of_customers, spend_multiplier,
                     weekly_from_sums)

DIMENSIONS = ("customer", "nation", "events")
ORDER_FACTS = ("custkey", "week_start", "urgent")


@dataclass
class Refresh:
    """The panel, the source files that were read for it, and the ISO years that were written."""

    panel: DataFrame
    read: list[str]
    years: list[int]


@dataclass
class Manifest:
    files: dict[str, dict] = field(default_factory=dict)    # table/path -> {"stamp": [size, time], "source": number}
    lines: list[dict] = field(default_factory=list)         # {"dir": ..., "waiting": whether its year 0 counts}
    orders: list[str] = field(default_factory=list)
    dimensions: list = field(default_factory=list)
    sources: int = 0
    due: list[int] = field(default_factory=list)


class _Store:
    """Files of the shared folder, through Spark's file system layer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def manifest(self) -> Manifest:
        at = self.path("manifest.json")
        if not at.getFileSystem(self.conf).exists(at):
            return Manifest()
        return Manifest(**json.loads("\n".join(r.value for r in self.spark.read.text(at.toString(), wholetext=True).collect())))

    def save(self, m: Manifest) -> None:
        new, at = self.path(f"manifest-{uuid.uuid4().hex}"), self.path("manifest.json")
        system = at.getFileSystem(self.conf)
        out = system.create(new, True)
        out.write(bytearray(json.dumps(vars(m)).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf)
        option = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, at, option)

    def write(self, df: DataFrame, kind: str, *by: str) -> str | None:
        """The name of a new state folder; none if there were no rows."""
        name = f"{kind}/batch={uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.folder}/{name}")
        if self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}").isEmpty():
            discard(self.spark, f"{self.folder}/{name}")
            return None
        return name


    def lines(self, dirs: list[str]) -> DataFrame:
        """The order totals of some states."""
        return self.spark.read.schema(LINES + ", batch string").option("basePath", f"{self.folder}/lines").parquet(*dirs).drop("batch")


LINES = ("source int, orderkey long, custkey long, week_start date, urgent boolean, ext decimal(28,2), disc decimal(38,9), "
         "net decimal(38,9), ret_net decimal(38,9), qty double, tax_a decimal(38,8), tax_b decimal(38,8), net_a decimal(38,9), "
         "net_b decimal(38,9), lines_a long, lines_b long, qty_a double, qty_b double, iso_year int")
SUMS = [c.split()[0] for c in LINES.replace("(38,", "(38;").replace("(28,", "(28;").split(", ")][5:-1]
ORDERS = "source int, orderkey long, custkey long, week_start date, urgent boolean"


class IncrementalPanel:
    """The weekly panel of a folder of tables, kept in a shared folder of its own."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, grain: str = "segment", econ: Economics = TABLE_ECONOMICS,
                 multipliers: dict[str, int] = SEGMENT_K, default_multiplier: int | None = None):
        self.spark, self.sf_dir, self.grain, self.econ = spark, sf_dir.rstrip("/"), grain, econ
        self.multipliers, self.default = multipliers, default_multiplier
        self.store = _Store(spark, folder)

    # -- states ----------------------------------------------------------------
    def _live(self, df: DataFrame, m: Manifest, table: str) -> DataFrame:
        alive = [(f["source"],) for k, f in m.files.items() if k.startswith(f"{table}/")]
        return df.join(F.broadcast(self.spark.createDataFrame(alive, "source int")), "source", "left_semi")  # a row per file

    def _orders(self, m: Manifest) -> DataFrame:
        dirs = [f"{self.store.folder}/{d}" for d in m.orders]
        df = self.spark.read.schema(ORDERS).parquet(*dirs) if dirs else self.spark.createDataFrame([], ORDERS)
        return self._live(df, m, "orders")

    def _lines(self, m: Manifest) -> DataFrame:
        out = self.spark.createDataFrame([], LINES)
        for waiting in (True, False):
            dirs = [f"{self.store.folder}/{x['dir']}" for x in m.lines if x["waiting"] is waiting]
            if dirs:
                x = self.store.lines(dirs)
                out = out.unionByName(x if waiting else x.filter("iso_year <> 0"))
        return self._live(out, m, "lineitem")

    def _read(self, table: str, paths: list[str], m: Manifest) -> DataFrame:
        """Rows of some files with the number of their file."""
        numbers = self.spark.createDataFrame([(p, m.files[f"{table}/{p}"]["source"]) for p in paths], "at string, source int")
        same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+:)/+", "$1/")
        x = self.spark.read.parquet(*paths).withColumn("at", same(F.col("_metadata.file_path")))
        return x.join(F.broadcast(numbers.withColumn("at", same(F.col("at")))), "at").drop("at")

    def _placed(self, lines: DataFrame, orders: DataFrame) -> DataFrame:
        x = lines.drop(*ORDER_FACTS, "iso_year").join(orders.drop("source").hint("shuffle_hash"), "orderkey", "left")
        return x.withColumn("iso_year", F.coalesce(iso_year("week_start"), F.lit(0))).select(
            *[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], LINES).schema])

    # -- refresh ---------------------------------------------------------------
    def refresh(self) -> Refresh:
        m = self.store.manifest()
        now = {f"{t}/{p}": [size, time] for t in ("orders", "lineitem") for p, size, time in table_files(self.spark, f"{self.sf_dir}/{t}.parquet")}
        gone = [k for k, f in m.files.items() if now.get(k) != f["stamp"]]
        new = [k for k in now if k not in m.files or k in gone]
        dimensions = [list(map(list, table_files(self.spark, f"{self.sf_dir}/{t}.parquet"))) for t in DIMENSIONS]
        due = set(m.due)
        if m.lines and dimensions != m.dimensions:
            due |= self._years(self._lines(m))
        # years of rows that no longer count
        old = [m.files[k]["source"] for k in gone if k.startswith("lineitem/")]
        if old:
            due |= self._years(self._lines(m).filter(F.col("source").isin(old)))
        lost_orders = any(k.startswith("orders/") for k in gone)
        before = self._years(self._lines(m)) if lost_orders else set()
        for k in gone:
            del m.files[k]
        for k in new:
            m.files[k] = {"stamp": now[k], "source": m.sources}
            m.sources += 1

        fresh = {t: [k.partition("/")[2] for k in new if k.startswith(f"{t}/")] for t in ("orders", "lineitem")}
        if fresh["orders"]:
            x = self._read("orders", fresh["orders"], m)
            name = self.store.write(x.select(
                "source", F.col("o_orderkey").cast("long").alias("orderkey"), F.col("o_custkey").cast("long").alias("custkey"),
                F.date_trunc("week", F.col("o_orderdate").cast("date")).cast("date").alias("week_start"),
                (F.col("o_orderpriority") == RETURNING_PRIORITY).alias("urgent")), "orders")
            m.orders += [name] if name else []
        if lost_orders:
            name = self.store.write(self._placed(self._lines(m), self._orders(m)), "lines", "iso_year")
            m.lines = [{"dir": name, "waiting": True}] if name else []
            due |= before | self._years(self._lines(m))
        elif fresh["orders"] and m.lines:
            waiting = self._lines(m).filter("iso_year = 0")
            due |= self._add(m, self._placed(waiting, self._orders(m)), [{**x, "waiting": False} for x in m.lines])
        if fresh["lineitem"]:
            # dealt by order as narrow lines: the sums per file and order, and their orders, then meet in place
            x = line_rows(self._read("lineitem", fresh["lineitem"], m), "source").repartition("orderkey")
            due |= self._add(m, self._placed(order_sums(x, "source"), self._orders(m)), m.lines)

        m.dimensions, m.due = dimensions, sorted(due - {0})
        self.store.save(m)
        self._write_years(m)
        years, m.due = m.due, []
        self.store.save(m)
        return Refresh(self.panel(), sorted(fresh["orders"] + fresh["lineitem"]), years)

    def _add(self, m: Manifest, lines: DataFrame, others: list[dict]) -> set[int]:
        """Write lines as one more state beside ``others``; the years they are in."""
        name = self.store.write(lines, "lines", "iso_year")
        m.lines = others + ([{"dir": name, "waiting": True}] if name else [])
        return self._years(self.store.lines([f"{self.store.folder}/{name}"])) if name else set()

    @staticmethod
    def _years(lines: DataFrame) -> set[int]:
        return {r.iso_year for r in lines.select("iso_year").distinct().collect()}  # a row per year

    def _fact(self, m: Manifest, years: list[int]) -> DataFrame:
        """The weekly fact of some years, from the states alone."""
        x = self._lines(m).filter(F.col("iso_year").isin(years))
        series = series_of_customers(self.spark, self.sf_dir, self.grain).hint("shuffle_hash")
        rows = x.join(series, "custkey").withColumn("k", spend_multiplier("segment", self.multipliers, self.default))
        # lines of one order may have come in several files: it is counted once, its sums add up from them
        orders = x.groupBy("orderkey", *ORDER_FACTS).agg(F.max(F.col("lines_b") > 0).alias("has_b")).join(series, "custkey")
        weeks = with_sessions(self.spark, self.sf_dir, weekly_from_sums(rows, orders), self.grain)
        return derive_metrics(fill_zero(weeks), self.econ)

    def _write_years(self, m: Manifest) -> None:
        if not m.due:
            return
        left = self._years(self._lines(m).filter(F.col("iso_year").isin(m.due)))
        for year in set(m.due) - left:
            discard(self.spark, f"{self.store.folder}/panel/iso_year={year}")
        if left:
            (self._fact(m, sorted(left)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("iso_year").parquet(f"{self.store.folder}/panel"))

    def panel(self) -> DataFrame:
        """The weekly fact as it was last written."""
        schema = self._fact(Manifest(), []).schema
        at = self.store.path("panel")
        if not at.getFileSystem(self.store.conf).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at.toString()).select(*schema.names)
