"""The streamed incremental rollup equals the batch rollup."""

import os
import shutil
import tempfile

from conftest import SF001
from panelcast.operators.prepare import weekly_fact
from panelcast.sources.tables import LINE_COLS
from panelcast.streaming.rollup_stream import start_line_totals_stream, weekly_from_stream_totals


def test_stream_rollup_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="panelcast-stream-src-")
    shutil.copy(os.path.join(SF001, "lineitem.parquet"), os.path.join(src, "part-0.parquet"))
    schema = spark.read.parquet(src).schema
    out = tempfile.mkdtemp(prefix="panelcast-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="panelcast-stream-ckpt-")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_line_totals_stream(stream.select(*LINE_COLS), out, ckpt)
    q.processAllAvailable()
    q.stop()
    got = weekly_from_stream_totals(spark, out, SF001).orderBy("series_id", "week_start").collect()
    exp = weekly_fact(spark, SF001).orderBy("series_id", "week_start").collect()
    assert got == exp and len(got) > 0
