import re

import pytest

from panelcast.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    """Share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, capped, target = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > repeat * sizes[s]]
        if not above:
            target.update({s: level * weight[s] for s in free})
            break
        for s in above:
            capped.add(s)
            target[s] = float(repeat * sizes[s])
            left -= target[s]
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, "d": 400, None: 7}, {"a": 1}, {"a": 5, "b": 5, "c": 5}, {"a": 0, "b": 9}, {"z": 1, "Z": 50, "é": 20}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(M.cycled_weights(df)).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])
        assert got[s] <= 2 * sizes[s]


def test_documents(documents):
    rows = M.op2_mixing(documents).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents.collect()}
    assert {r.doc_id: r["size"] for r in rows} == words
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(words.values()), rel=0.2)
    assert sorted(map(tuple, M.op2_mixing(documents.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_copies_have_the_wanted_mean(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'w w' as text", "if(id % 10 = 0, 'a', 'b') as source")
    got = {r.source: (r.t, r.target) for r in M.op2_mixing(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source")
           .agg({"taken": "sum", "target": "max"}).toDF("source", "t", "target").collect()}
    for taken, target in got.values():
        assert taken == pytest.approx(target, rel=0.03)


def test_odd_rows(odd, empty):
    out = M.op2_mixing(odd).collect()
    assert len(out) == odd.count()
    assert all(r["size"] == 0 and r.taken == 0 for r in out if r.doc_id in (5, 6, 7))
    assert M.op2_mixing(empty).collect() == []
    stage = M.mixing_stage(odd)
    assert stage.columns == odd.columns
    assert stage.count() == sum(r.copies for r in M.with_copies(odd.select("doc_id", "source", "text")).collect())


def test_plan_is_native(documents):
    plan = M.op2_mixing(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
