"""Helpers shared by the corpus operators: tables, word pattern, staged data."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id wherever ids are compared, below every real one.
NULL_ID = -(2**63) + 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/panelcast-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing),
    and gives the planner the real size of what follows, so that its own
    size-checked rule decides whether a join broadcasts it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/panelcast-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries run inside give up their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Bytes of a batch that a Python worker gets at once (by default 10,000 rows, whatever their size).
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession, size: int = BATCH) -> None:
    """Batches for Python workers of about ``size`` bytes from here on, unless the session has a bound of its own:
    a batch is held by the executor and by the worker, and neither gives its memory back to the system."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(size))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
