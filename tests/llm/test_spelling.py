"""Spelling variants: the query against SQL and loops, pairs on chosen words, large groups, very long words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from panelcast.llm import spelling
from panelcast.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    out, form = {}, {}
    for w in n:
        near = sorted((v for v in n if abs(len(v) - len(w)) < 2 and v != w and is_near(v, w)), key=lambda v: (-n[v], v))
        if near and n[near[0]] >= 10 * n[w]:
            form[w] = near[0]
        out[w] = (n[w], len(near))
    rows = []
    for w, (k, near) in out.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, k, near, n.get(form.get(w))))
    return sorted(rows, key=str)


def test_query_against_sql_and_loops(spark, documents):
    got = QUERIES["op12_spelling"](spark, SF001)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, got.collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    assert rows == sorted(c.execute(spelling.SQL).fetchall(), key=str)
    assert rows == plain_variants([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd, empty):
    got = sorted(map(tuple, spelling.op12_spelling(odd).collect()), key=str)
    assert got == plain_variants([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert spelling.op12_spelling(empty).collect() == []


@pytest.mark.parametrize("group", [1, 4, 64])
@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_pairs_are_whole_at_every_alphabet(spark, symbols, group):
    rnd = random.Random(11)
    words = {"".join(rnd.choice("abcdeéÿ÷z") for _ in range(rnd.randint(1, 9))) for _ in range(150)}
    for w in list(words):
        k = rnd.randrange(len(w))
        words |= {w[:k] + w[k + 1:] or "a", w[:k] + rnd.choice("abß") + w[k + 1:], w[:k] + rnd.choice("xyé") + w[k:]}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaabaaa", "baaaaaaa", "aaaaaab"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    want = {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    found = [tuple(r) for r in spelling.near_pairs(df, symbols, group).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_chain_of_forms(spark):
    """abcdefgh < abcdefg < abcdefgi ...: each ten times as frequent; ties go to the least word."""
    texts = [("zzcdefgh", 2), ("zbcdefgh", 20), ("abcdefgh", 200), ("abcdefghi", 2000), ("abcdefghj", 2000), ("lonelyword", 3)]
    df = spark.createDataFrame([(w, n) for w, n in texts], "word string, n long")
    # ids for which no letter slips
    ids = {w: next(k for k in range(10_000) if zlib.crc32(f"{k}:{w}".encode()) % 31) for w, _ in texts}
    docs = spark.createDataFrame([(ids[w], " ".join([w.upper()] * n)) for w, n in texts], "doc_id long, text string")
    got = {r.word: r for r in spelling.op12_spelling(docs).collect()}
    assert set(got) == {w for w, _ in texts} and df.count() == len(got)
    assert [got[w].form for w, _ in texts] == ["zbcdefgh", "abcdefgh", "abcdefghi", None, None, None]
    assert [got[w].root for w, _ in texts] == ["abcdefghi"] * 4 + ["abcdefghj", "lonelyword"]
    assert [got[w].n_near for w, _ in texts] == [1, 2, 3, 2, 2, 0]


def test_very_long_words(spark):
    long = "".join(random.Random(5).choices("abcdefgh", k=30_000))
    words = [long, long[:20_000] + long[20_001:], long[:5] + "z" + long[6:], long + "é", long[::-1]]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {tuple(sorted((words[0], w))) for w in words[1:4]}
    for group in (0, 64):
        assert {tuple(r) for r in spelling.near_pairs(df, group=group).collect()} == want


def test_large_group_makes_no_square(spark):
    """2,000 words of one reduced form: candidates come from shared deletions, not from crossing the group."""
    same = [x for x in spelling.LETTERS if spelling.symbol_of(x, 8) == spelling.symbol_of("a", 8)][:6]
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice(same) for _ in range(12)) for _ in range(2000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    keyed = spelling.with_key(df.select("word", spelling.reduced(F.col("word")).alias("reduced")), "reduced")
    assert keyed.select("key").distinct().count() == 1
    edits = spelling.deletion_keys(df).groupBy("key").count()
    assert edits.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 40 * len(words)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if is_near(a, b)}
    assert {tuple(r) for r in spelling.near_pairs(df).collect()} == want
