import numpy as np
import pytest

from panelcast.llm import ann as A

SF001 = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(np.array(ids) % 20 == 0):
        score = np.add.accumulate(x * x[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(r + 1, ids[j], score[j]) for r, j in enumerate(order)]
    return out


def digest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    p = df.toPandas().sort_values("vec_id")
    want = brute(p.vec_id.tolist(), np.stack(p.embedding.to_list()).astype(float))
    assert digest(A.op1_ann(df).collect()) == want


@pytest.mark.parametrize("kind", ["noise", "clusters", "one hot vector"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    if kind == "clusters":
        x = rng.normal(size=(12, 32))[rng.integers(0, 12, 1500)] + 0.1 * x
    if kind == "one hot vector":
        x[rng.random(1500) < 0.4] = x[7]
    x = x.astype(np.float32)
    df = frame(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    got = digest(A.neighbours(df, df.filter("vec_id % 20 = 0"), probes=2, list_rows=100, row_block=64, query_block=16).collect())
    want = brute(list(range(1500)), x.astype(float))
    assert got.keys() == want.keys()
    hits = [len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.99
    assert all([r for r, _, _ in got[q]] == list(range(1, 21)) for q in got)


def test_bounds_hold_the_inner_product():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(800, 64)), rng.normal(size=(40, 64))
    centres, rotate = A.kmeans(x, 4), A.rotation(64)
    at, code, norm, fit = A.encode(x, centres, rotate)
    assert code.shape == (800, 8)
    own = at == 0
    low, high = A.bounds(q, code[own], norm[own], fit[own], centres[0], rotate)
    true = q @ x[own].T
    assert ((low <= true) & (true <= high)).mean() > 0.999
    assert abs(((low + high) / 2 - true).mean()) < 0.05


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [5.0, 5.0]), (7, [1.0]), (8, []), (40, [0.0, 0.0]), (9, [-1.0, 0.0])]
    got = digest(A.op1_ann(frame(spark, rows).repartition(3)).collect())
    assert got == {0: [(1, 6, 1.0), (2, 20, 0.0), (3, 9, -1.0)], 20: [(1, 6, 1.0), (2, 0, 0.0), (3, 9, 0.0)]}
    assert A.op1_ann(frame(spark, [])).collect() == []
    assert A.op1_ann(frame(spark, [(0, [1.0])])).collect() == []


@pytest.mark.parametrize("kind", ["every row twice", "two vectors an id", "one hot id"])
def test_rows_that_share_an_id(spark, kind):
    """k distinct ids come back, each with the best score of its rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32).astype(float)
    rows = list(enumerate(x))
    if kind == "every row twice":
        rows += rows
    if kind == "two vectors an id":
        rows += list(enumerate(x + rng.normal(size=x.shape).astype(np.float32)))
    if kind == "one hot id":
        rows += [(7, v) for v in 2 * rng.normal(size=(400, 16)).astype(np.float32).astype(float)] + [(8, x[8])] * 400
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    df = frame(spark, [(i, v.tolist()) for i, v in rows]).repartition(3)
    ids, every = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    want = {}
    for q in range(0, 600, 20):
        score = {}
        for v in every[ids == q]:
            for i, s in zip(ids.tolist(), np.add.accumulate(every * v, axis=1)[:, -1].tolist()):
                if i != q:
                    score[i] = max(s, score.get(i, -np.inf))
        want[q] = [(r + 1, i, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda e: (-e[1], e[0]))[:20])]
    assert digest(A.op1_ann(df).collect()) == want
    asked = df.filter("vec_id % 20 = 0")
    assert digest(A.neighbours(df, asked, probes=1, list_rows=100, row_block=64, query_block=16).collect()) == want


def block(x, q, ids, asked, k=20, least=None):
    centres, rotate = x.mean(axis=0, keepdims=True), A.rotation(x.shape[1])
    _, code, norm, fit = A.encode(x, centres, rotate)
    least = np.full(len(q), -np.inf) if least is None else least
    return A.search_block(asked, q, ids, x, code, norm, fit, centres[0], rotate, k, least)


def test_only_the_best_are_summed_in_order(monkeypatch):
    """Codes of far vectors part little; a matrix product parts the rest before rows are summed one by one."""
    x = np.random.default_rng(3).normal(size=(2000, 64))
    summed, exact = [], A.exact
    monkeypatch.setattr(A, "exact", lambda a, b: summed.append(len(a)) or exact(a, b))
    asked = np.arange(0, 2000, 20)
    query_id, vec_id, score = block(x, x[asked], np.arange(2000), asked)
    assert max(summed) <= 30
    for q, want in brute(list(range(2000)), x).items():
        assert [(r + 1, v, s) for r, (v, s) in enumerate(zip(vec_id[query_id == q], score[query_id == q]))] == want


@pytest.mark.parametrize("size", [1e-38, 1e-3, 1e37])
def test_sizes_that_a_product_rounds_away(size):
    """Ties and sums that only their order parts come back as the sums in order have them."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 16)), 5, axis=0) * (1 + 1e-16 * rng.integers(0, 3, (200, 16))) * size
    asked = np.arange(0, 200, 20)
    query_id, vec_id, score = block(x, x[asked], np.arange(200), asked)
    for q, want in brute(list(range(200)), x).items():
        assert [(r + 1, v, s) for r, (v, s) in enumerate(zip(vec_id[query_id == q], score[query_id == q]))] == want
