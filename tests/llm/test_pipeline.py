import re

import corpus_pipeline
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as near_brute
from test_packing import check_places

from panelcast.llm import near_dedup, queries

SF001 = "/root/testdata/sf0.001"


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert len(queries.QUERIES) == 13 and set(queries.SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_each_stage_on_its_own_input(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001).cache()
        if name == "packing":
            check_places(out.collect())
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            continue
        assert out.columns == documents.columns
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
        if name == "line_dedup":
            import hashlib

            want = {d: h for d, _, _, h in lines_brute(before)}
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after} == want
        if name == "near_dedup":
            assert sorted(d for d, _ in after) == sorted(d for d, _, c in near_brute(before, near_dedup.STAGE_PERCENT) if d == c)
        if name == "mixing":
            assert set(after) <= set(before) and 1.0 < len(after) / len(before) < 2.0
        docs = out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF001).collect()
    assert rows and check_places(rows) <= len(rows)


def test_empty(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out


def test_stages_bound_the_bytes_of_a_batch(spark, documents):
    """A batch of 10,000 rows is as large as its texts; the stages with Python workers bound its bytes, and keep a bound that is set."""
    from panelcast.llm.common import BATCH, BATCH_BYTES
    from panelcast.llm import lang_id, near_dedup, packing

    before = spark.conf.get(BATCH_BYTES, None)
    try:
        for stage in (lang_id.lang_id_stage, near_dedup.near_dedup_stage, lambda d: packing.pack(d.select("doc_id", "text"))):
            spark.conf.unset(BATCH_BYTES)
            stage(documents)
            assert spark.conf.get(BATCH_BYTES, None) == str(BATCH)
        spark.conf.set(BATCH_BYTES, "1000000")
        lang_id.lang_id_stage(documents)
        assert spark.conf.get(BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)
