import re
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from panelcast.llm import url_filter as U

SF001 = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate(LOWER)
    best = None
    for rule, verdict in U.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def check(df):
    rows = U.op8_url_filter(df).collect()
    want = Counter((r.page_id, *brute(r.url)[:2], (brute(r.url)[2] or (None,))[0]) for r in df.collect())
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == want
    says = dict(U.RULES)
    assert all(r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block") for r in rows)
    return rows


def test_pages(spark):
    df = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = check(df)
    assert {r.verdict for r in rows if r.rule is None}
    assert all((r.score is None) == (r.rule is not None) for r in rows)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/en", "http://example.com/en/",
            "http://notexample.com/en/", "http://a.www.example.com/en/?q#f", "x://net/es/", "x://a.net/fr/1", "x://net/es", "http://com/",
            "http://com", "http://x.com?y/z", "a://b://c.net/es/", "http://ÀB.net/fr/é", "http://x.net/es/" + "a1-" * 20_000, "http://x.net/de/"]
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(0, None, "h"), (None, "x://a.net/es/", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("host", "path", "rule", "verdict", "score", "prediction", "features", "label")})
    check(df.repartition(3))
    assert U.op8_url_filter(df.limit(0)).collect() == []


def test_one_sided_or_no_labels(spark):
    df = lambda urls: spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in U.op8_url_filter(df(["x://a.org/", "y"])).collect()} == {"allow"}
    assert {r.verdict for r in U.op8_url_filter(df(["x://a.net/es/", "y"])).collect()} == {"block"}


def test_trees_learn_what_urls_look_like(spark):
    """Rules label by a word in the host; unlabelled hosts with the same shape get the same verdict."""
    rows = []
    for k in range(600):
        spam = k % 3 == 0
        tail = f"/{k}?a={k}&b=1&c=2&d=3" if spam else f"/post-{k}"
        rows.append((k, f"http://h{k % 40}.{'bad' if spam else 'good'}.test{tail}" if k < 450 else f"http://h{k % 40}.other.zone{tail}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = U.judge_urls(df, rules=(("bad.test/", "block"), ("good.test/", "allow"))).filter("rule is null").collect()
    right = [r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in out]
    assert sum(right) / len(right) > 0.9


@pytest.mark.parametrize("text", ["", "aaaa", "abab", "http://example.com/12"])
def test_entropy(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(U.entropy(F.col("t"))).first()[0]
    assert got == pytest.approx(-sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values()) if text else 0.0)


def test_plan_is_native(spark):
    plan = U.op8_url_filter(spark.read.parquet(f"{SF001}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pages_of_one_url_are_drawn_each_on_their_own(spark, seed):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://a.com/hot").alias("url"))
    assert 300 < df.filter(U.in_sample(0.1, seed)).count() < 500


def test_a_rare_verdict_is_drawn_and_the_sample_stays_bounded(spark):
    """3 of 30,000 labelled pages are blocked, a sample of 100: they are in it, and nothing else is added."""
    known = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("x://h.com/"), F.col("id")).alias("url"),
                                       F.when(F.col("id") < 3, "block").otherwise("allow").alias("rule_verdict"))
    got = {r["rule_verdict"]: r["count"] for r in U.labelled_sample(known, {"allow": 29_997, "block": 3}, 100, 20, 7)
           .groupBy("rule_verdict").count().collect()}
    assert got["block"] == 3 and 60 < got["allow"] < 150
    # many copies of one blocked page that is not drawn: the first ones are taken
    same = spark.range(20_000).select(
        F.lit(1).cast("long").alias("page_id"), F.lit("x://z.net/es/0").alias("url"), F.lit("block").alias("rule_verdict"))
    both = known.filter("rule_verdict = 'allow'").unionByName(same)
    seed = next(s for s in range(50) if not same.limit(1).filter(U.in_sample(0.01, s)).count())
    got = {r["rule_verdict"]: r["count"] for r in U.labelled_sample(both, {"allow": 29_997, "block": 20_000}, 100, 20, seed)
           .groupBy("rule_verdict").count().collect()}
    assert got["block"] == 20 and 20 < got["allow"] < 150


def test_held_out_rows_of_the_rules(spark):
    """The trees, fitted on a fifth of the rows that rules decide, agree with the rules on the others; a row's own
    verdict is not among its features."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    n = df.count()
    out = U.judge_urls(df, sample_rows=n // 10, least=50)
    known = out.filter("rule is not null").withColumn("verdict", F.expr("verdict"))
    held = known.filter(~U.in_sample(0.5, 7))
    rows = held.select("verdict", "by_trees").collect()
    assert len(rows) > 100 and sum(r.verdict == r.by_trees for r in rows) / len(rows) > 0.9


def test_own_verdict_is_left_out(spark):
    rows = [(1, "a.zz", "block"), (2, "b.zz", None), (3, "c.yy", "allow"), (4, "d.yy", "block")]
    df = spark.createDataFrame(rows, "page_id long, host string, rule_verdict string")
    got = {r.page_id: r.f_blocked1 for r in U.with_suffix_statistics(df).collect()}
    assert got == {1: 1 / 2, 2: 2 / 3, 3: 2 / 3, 4: 1 / 3}
