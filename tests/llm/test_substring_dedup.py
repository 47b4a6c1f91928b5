import hashlib
import random

import numpy as np
import pytest

from panelcast.llm import substring_dedup as D


def digest(df, **kw):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
            for r in D.dedup_substrings(df, **kw).collect()}


def brute(df):
    return D.brute_force([(D.NULL_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()])


def test_documents(documents):
    assert digest(documents) == brute(documents)


def test_hot_positions_take_single_ranks(documents):
    assert digest(documents, slice_rows=3) == brute(documents)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_repeats(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab" if seed == 1 else "abcdefghé "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool)[rng.randrange(30):] for _ in range(rng.randrange(0, 5))) + str(k)) for k in range(80)]
    rows += [(200, "z" * 400), (201, "y" + "z" * 90), (202, "ab" * 120), (203, pool[0] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(df, names_per_slice=50) == brute(df)


def test_names_tell_strings_apart():
    b = np.frombuffer(b"abcabcabcabcabcX", np.uint8)
    for n in (1, 2, 3, 5, 8, 11):
        strings = [bytes(b[k:k + n]) for k in range(len(b) - n + 1)]
        got = D.names(b, n).tolist()
        assert len(got) == len(strings)
        assert len(set(got)) == len(set(strings)) == len(set(zip(got, strings)))


def test_odd_rows(spark, odd, empty):
    rows = [(1, "p" * 60), (2, "p" * 60), (2, "q" * 70 + "p" * 55), (2, "q" * 70 + "p" * 55), (3, "q" * 50), (None, "p" * 80), (4, "é" * 40),
            (5, "é" * 41), (6, "x" * 49), (7, "x" * 49), (8, None)]
    out = D.op4_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in out), key=str)
    assert got == sorted([(1, 60, 60, 1), (2, 60, 60, 1), (2, 125, 55, 1), (2, 125, 55, 1), (3, 50, 50, 1), (None, 80, 0, 0),
                          (4, 80, 0, 0), (5, 82, 82, 1), (6, 49, 0, 0), (7, 49, 0, 0), (8, 0, 0, 0)], key=str)
    assert D.op4_substring_dedup(empty).collect() == []
    assert D.op4_substring_dedup(odd).count() == odd.count()


def test_pairs_are_sent_in_their_own_order():
    """Sorted pairs lie in the order of their slices of the names; what is asked for them comes back in place."""
    pair = np.unique(D._mix(np.arange(1, 5000, dtype=np.uint64)))
    dealt = D.Dealt(pair, 26, True)
    assert dealt.order is None and [a for _, a, _ in dealt.parts[1:]] == [b for _, _, b in dealt.parts[:-1]]
    assert len(dealt.parts) == 26 and max(b - a for _, a, b in dealt.parts) < 2 * 5000 / 26
    sent = next(dealt.sent(7, pair, np.arange(len(pair)) % 2 == 0))
    assert b"".join(sent.column(2).to_pylist()) == pair.tobytes()
    got = [{"slot": s, "answer": m} for s, m in zip(sent.column(0).to_pylist(), sent.column(3).to_pylist())]
    assert (dealt.answers(got, bool) == (np.arange(len(pair)) % 2 == 0)).all()
    assert D.Dealt(pair[:0], 26, True).parts == [] and len(D.Dealt(pair[:0], 26, True).answers(None, bool)) == 0


def test_ranked_positions_are_live_ones_and_their_partners():
    text = bytes(range(256)) * 3
    s = D.Slice(np.array([1], np.int64).tobytes(), np.array([len(text)], np.int64).tobytes(), text)
    p = np.r_[np.arange(5, 9), 10, 700, len(text) - D.SPAN]
    q, pair, number, before = D.Positions(4, 2).pairs(s, p)
    assert q.tolist() == sorted({int(x) + k for x in p for k in range(D.REST + 1)})
    assert (q[before[p]] == p).all() and (q[before[p + D.REST]] == p + D.REST).all()
    assert (pair[number] == D._pair(s.gram[q], s.gram[q + D.GRAM])).all()
