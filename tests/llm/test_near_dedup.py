import random
import re
from collections import defaultdict

import numpy as np
import pytest

from panelcast.llm import near_dedup as N
from panelcast.llm.common import LOWER, UPPER, WORD


def brute(rows, percent=85):
    """(id, set size, component) by all pairs that share a shingle; rows of one id are one node."""
    sets = defaultdict(list)
    for d, t in rows:
        w = re.findall(WORD, (t or "").translate(str.maketrans(UPPER, LOWER)))
        sets[d].append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, all_sets in sets.items() for s in all_sets if s]
    held = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            held[x].append(k)
    for k, (d, s) in enumerate(flat):
        shared = defaultdict(int)
        for x in s:
            for other in held[x]:
                if other < k:
                    shared[other] += 1
        for other, n in shared.items():
            e, z = flat[other]
            if 100 * n >= percent * (len(s) + len(z) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, all_sets in sets.items() for s in all_sets)


def digest(df):
    return sorted((r.id, r.n, r.component) for r in N.near_duplicates(df).collect())


def rows_of(df):
    return [(N.NULL_ID if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]


def test_documents(documents):
    assert digest(documents) == brute(rows_of(documents))


def test_odd_rows(odd, empty):
    assert digest(odd) == brute(rows_of(odd))
    out = N.op9_near_dedup(odd)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {(r.doc_id, r.kept) for r in out.collect() if r.doc_id in (8, 9, 11, 12)} == {(8, True), (9, False), (11, True), (12, False)}
    assert digest(empty) == []
    stage = N.near_dedup_stage(odd)
    assert stage.columns == odd.columns
    assert stage.filter("doc_id in (9, 12)").count() == 0 and stage.filter("doc_id = 8").count() == 1
    assert N.near_dedup_stage(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_family_around_the_threshold(spark, seed):
    """Many variants of one text, most pairs near the threshold, chains among them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, last = [], base
    for k in range(150):
        words = list(last if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], [f"x{rng.randrange(50)}"], [words[at], words[at]]])
        last = words
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(df) == brute(rows)


def test_short_texts(spark):
    rows = [(k, t) for k, t in enumerate(["a", "A", "a b", "b a", "a b c d e", "A b c d e", "a b c d e f", "", None, " "])]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_signature_agrees_as_often_as_the_sets():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        agree.append((N.signature(x[:360]) == N.signature(x[40:])).mean())
    assert np.mean(agree) == pytest.approx(320 / 400, abs=0.02)
    assert (N.signature(np.array([5], np.uint64)) == N.signature(np.array([5], np.uint64))).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.component for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(k, k) for k in range(41)} == {0} and got[100] == got[95] == 90
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_links_at_80(spark):
    """Pairs of similarity 0.80 to 0.85 go in the stage and stay in the query."""
    words = [[f"w{k}x{n}" for n in range(104)] for k in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)]
    for k, w in enumerate(words):
        # 100 shingles; new words at the end replace 5 + k of them
        rows.append((100 + k, " ".join(w[:99 - k] + [f"new{k}x{n}" for n in range(5 + k)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(d for d, _, c in brute(rows, 80) if d == c)
    assert len(want) < len([d for d, _, c in brute(rows, 85) if d == c])
    assert sorted(r.doc_id for r in N.near_dedup_stage(df).collect()) == want
    assert digest(df) == brute(rows, 85)


def test_stage_on_documents(documents):
    want = sorted(d for d, _, c in brute(rows_of(documents), 80) if d == c)
    assert sorted(r.doc_id for r in N.near_dedup_stage(documents).collect()) == want


def test_stage_keeps_one_row_of_copies(spark):
    """Repeated rows and copies without ids go like any other; nothing unlike goes with them."""
    text = [" ".join(f"t{k}w{n}" for n in range(60)) for k in range(8)]
    rows = [(1, text[0]), (1, text[0]), (1, text[0].upper()), (2, text[0])]  # repeated rows, one set
    rows += [(3, text[1]), (3, text[2])]  # one id, two sets
    rows += [(None, text[3])] * 3 + [(None, text[3] + " more"), (4, text[3])]  # copies and near copies without ids
    rows += [(None, text[4]), (None, text[5]), (5, text[5])]
    rows += [(None, None), (None, ""), (None, ""), (6, ""), (6, ""), (7, text[6])]
    out = N.near_dedup_stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    shape = lambda x: (x is None, x or 0)
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in out if r.text not in (None, "")), key=lambda r: (shape(r[0]), r[1]))
    some = [r for r in got if r != (None, text[3]) and r != (None, text[3] + " more")]
    assert some == sorted([(1, text[0]), (3, text[1]), (3, text[2]), (7, text[6]), (None, text[4]), (None, text[5])],
                          key=lambda r: (shape(r[0]), r[1]))
    assert len(got) == len(some) + 1
    assert [shape(r.doc_id) for r in out if r.text in (None, "")].count((True, 0)) == 3
    assert [r.doc_id for r in out].count(6) == 1
