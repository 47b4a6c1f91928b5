import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def check_statistics(df):
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    rows = Q.op10_quality(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str)
    assert got == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.distance is None) == r.base_failed
    return rows


def test_documents(documents):
    check_statistics(documents)


def test_odd_rows(spark, odd, empty):
    check_statistics(odd)
    texts = ["a a a a", "a b c a b c", "a b a b a", " x\n x\nx\n\n \n x", "a b c d a b c", "é#é $", "\x0b\x0c\r\n", "a\tb\tc\na b c"]
    check_statistics(spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)],
                                           "doc_id long, text string, lang string, source string"))
    assert Q.op10_quality(empty).collect() == []


def test_chi_square():
    assert Q.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-3)
    assert Q.chi2_cdf(6.6257, 7) == pytest.approx(0.531, abs=2e-3)
    assert Q.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


def test_outliers_do_not_move_the_estimate(spark):
    """A fifth of a group is far off; the estimate and the verdicts follow the rest."""
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
    x = rng.normal(size=(3000, 5)) @ mix.T
    bad = rng.random(3000) < 0.2
    x[bad] = x[bad] * 0.2 + 60
    df = spark.createDataFrame([(k, "en", "s", *map(float, v)) for k, v in enumerate(x)],
                               "doc_id long, lang string, source string, f1 double, f2 double, f3 double, f4 double, f5 double")
    estimate = Q.start(df)
    for _ in range(4):
        estimate = Q.concentrate(df, estimate, 0.75, 0)
    got = estimate.first()
    mean, cov = x[~bad].mean(axis=0), np.cov(x[~bad].T)
    low = np.zeros((5, 5))
    for i, j in Q.PAIRS:
        low[i, j] = got[f"l{i}{j}"]
    assert np.abs([got[f"m{k}"] for k in range(5)] - mean).max() < 0.3
    # the shape is that of the rest; the scale counts on a quarter left out, of which a fifth was bad
    scale = np.trace(low @ low.T) / np.trace(cov)
    assert 1.0 < scale < Q.consistency(0.75)
    assert np.abs(low @ low.T / scale - cov).max() < 0.1 * np.abs(cov).max()
    d2 = {r.doc_id: r.d2 for r in Q._distance(df, estimate).collect()}
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert np.corrcoef([d2[k] for k in np.flatnonzero(~bad)], want[~bad])[0, 1] > 0.98
    cut = Q.chi2_quantile(1 - 1e-9, 5)
    assert all(d2[k] > cut for k in np.flatnonzero(bad)) and np.mean([d2[k] <= cut for k in np.flatnonzero(~bad)]) > 0.999


def test_small_groups_borrow_from_their_language(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "en", "big" if k < 900 else f"s{k}", *map(float, rng.normal(size=5))) for k in range(920)]
    rows += [(2000, "xx", None, *([1.0] * 5)), (2001, None, None, *([0.0] * 5))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, f1 double, f2 double, f3 double, f4 double, f5 double")
    estimate = Q.concentrate(df, Q.start(df), 0.75, 20)
    d2 = Q._distance(df, estimate)
    assert d2.filter("d2 is null").count() == 0
    assert d2.filter(F.col("d2") > Q.chi2_quantile(1 - 1e-9, 5)).count() == 0


def test_junk_goes_and_prose_stays(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Q.op10_quality(docs).join(labels, "doc_id").filter("not base_failed")
    kept = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_plan_is_native(documents):
    plan = Q.op10_quality(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
