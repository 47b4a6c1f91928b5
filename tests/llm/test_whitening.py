"""Whitening: against an eigendecomposition in numpy, rank and scale extremes, odd tables."""

import math

import numpy as np
import pytest

from panelcast.llm import whitening
from panelcast.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def plain(vectors, k=16):
    """n, exact deviations, whitened rows, eigenvalue shares and eigenvalues of the usable vectors."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array((fit * n - s) / 1, float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    return n, ((x * n - s) ** 2).sum(axis=1), np.array(x * n - s, float) / n @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), e


def held_against(out, ids, vectors, components, accuracy=1e-9):
    n, deviation, white, share, _ = plain(vectors)
    at = {i: k for k, i in enumerate(ids)}
    assert sorted(set(out.component)) == list(range(1, components + 1))
    assert len(out) == components * len(ids)
    row, c = out["id"].map(at).to_numpy(), out.component.to_numpy() - 1
    assert (out.n == n).all() and list(out.deviation) == [deviation[r] for r in row]
    sign = np.array([np.sign((out.whitened[c == k] * white[row[c == k], k]).sum()) for k in range(components)])
    assert np.abs(out.whitened - white[row, c] * sign[c]).max() < accuracy
    assert np.abs(out.explained / share[c] - 1).max() < 1e-8
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-6


def test_query_on_the_table(spark):
    got = QUERIES["op13_whitening"](spark, SF001)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    held_against(got.toPandas().rename(columns={"vec_id": "id"}), [r.vec_id for r in rows], [r.embedding for r in rows], 16)


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v])
                                  for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")


def test_odd_rows(spark):
    rnd = np.random.default_rng(1)
    good = rnd.normal(size=(40, 5)).tolist()
    bad = [None, [], [None] * 5, [1.0, math.nan, 0, 0, 0], [math.inf, 0, 0, 0, 0], [-math.inf, 0, 0, 0, 0], [1.0, 2.0], [1.0] * 6]
    clash = ("id", "x", "c", "n", "component", "dims", "stripe", "part", "salt")
    df = frame(spark, good + good[:3] + bad)  # three vectors twice
    for name in clash:
        df = df.selectExpr("*", f"'z' AS {name}")
    out = whitening.whiten(df.repartition(3)).toPandas()
    held_against(out, range(43), good + good[:3], 5)
    assert set(whitening.op13_whitening(df).columns) >= {"vec_id", "whitened"}
    twice = frame(spark, good + good, [*range(40), *[None] * 40])
    assert whitening.whiten(twice).count() == 400 and whitening.whiten(twice).filter("id is null").count() == 200


def test_no_spread_and_empty(spark):
    assert whitening.op13_whitening(frame(spark, [])).count() == 0
    assert whitening.op13_whitening(frame(spark, [None, [math.nan]])).count() == 0
    same = whitening.op13_whitening(frame(spark, [[1.0, 2.0]] * 5))
    assert same.count() == 0 and same.columns[0] == "vec_id"


@pytest.mark.parametrize("rank", [1, 3])
def test_dependent_dimensions(spark, rank):
    """Constant, repeated and summed dimensions, and fewer vectors than dimensions: as many components as rank."""
    base = np.random.default_rng(2).integers(-50, 50, size=(60, rank)) * 1.0
    wide = np.column_stack([base, base[:, :1], base.sum(axis=1), np.full(60, 3.0)])
    held_against(whitening.whiten(frame(spark, wide.tolist())).toPandas(), range(60), wide.tolist(), rank)
    few = np.random.default_rng(3).normal(size=(rank + 1, 20)) * 5
    held_against(whitening.whiten(frame(spark, few.tolist())).toPandas(), range(rank + 1), few.tolist(), rank)


def test_components_of_very_unequal_spread(spark):
    """Condition 1e6 of the rows (1e12 of their Gram matrix): the least component is right too."""
    rnd = np.random.default_rng(4)
    wide = rnd.integers(-1, 2, size=(300, 4)) @ np.diag([1, 1e2, 1e4, 1e6])
    out = whitening.whiten(frame(spark, wide.tolist())).toPandas()
    x = wide * 64
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    want = np.linalg.svd(y, compute_uv=False) ** 2 / len(fit)
    share = out.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(share / (want / want.sum()) - 1).max() < 1e-6
    assert out.identity_error[0] < 1e-6


def test_extreme_entries(spark):
    """Entries beyond the bound are held there; deviations beyond 64 bits are null, all others exact."""
    out = whitening.whiten(frame(spark, [[1e300, 0.0], [-1e300, 1.0], [3.0, 5.0], [3.0, 5.5]])).toPandas()
    assert out.deviation.isna().any() and np.isfinite(out.whitened).all()
    near = [[1e6, 1.0], [1e6, 2.0], [-1e6, 1.5], [1e6 + 1 / 64, 0.5]]
    out = whitening.whiten(frame(spark, near)).toPandas()
    assert list(out.drop_duplicates("id").sort_values("id").deviation) == [int(d) for d in plain(near)[1]]


def test_many_stripes_and_partitions(spark):
    """More dimensions than a stripe has rows; results do not hang on the partitions."""
    x = np.random.default_rng(5).normal(size=(400, 150)) * 3
    one = whitening.whiten(frame(spark, x.tolist()).repartition(1)).toPandas()
    held_against(one, range(400), x.tolist(), 16)
    held_against(whitening.whiten(frame(spark, x.tolist()).repartition(13)).toPandas(), range(400), x.tolist(), 16)


def test_solve_is_the_inverse():
    rnd = np.random.default_rng(6)
    r = np.triu(rnd.normal(size=(7, 7))) + 5 * np.eye(7)
    rows = rnd.normal(size=(20, 7))
    assert np.allclose(whitening.solve(rows.copy(), r) @ r, rows)
