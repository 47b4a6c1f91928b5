"""Approximate nearest neighbours by randomly rotated one-bit codes, inner product.

Index: centroids (k-means in numpy on at most ``sample_rows`` rows, a documented
bound, those with the least hashes) and a random rotation.  Every row goes to
the list of its nearest centroid and is coded as the signs of its rotated
residual, packed to bits, with two scalars: the residual's norm and its inner
product with the code's unit vector.  From those the inner product with any
query is estimated without bias, with an error bound; within a list, the rows
whose upper bound reaches the k-th best lower bound are rated on the original
vectors by one matrix product, and those that its rounding cannot part from the
k best are reranked by sums in order, in double precision.

A query first probes the ``probes`` lists whose centroids have the largest inner
product with it.  Its k-th best score then excludes every list whose bound,
the centroid's inner product plus the query's norm times the largest residual
norm of the list, lies below it; the second pass probes all others, where that
score also limits what is reranked.  Vectors in dense clusters stop after a few
lists, vectors far from all others look at every code.  Rows of a list and
queries that probe it meet in blocks of bounded size, (list, row block, query block), so a third of all rows being one
vector or one id, or all queries probing one list, only makes more blocks.  Each
block hands on at most k distinct ids a query, with their best scores.

Defined results: a vector that is null, zero, or holds a null or non-finite
component takes no part, nor does a row with a null id or with another length
than most vectors; repeated rows of one id are one candidate with its best
score, and one query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Half-width of the estimate's confidence interval, in standard deviations of the rotation.
EPSILON = 4.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def encode(x: np.ndarray, centres: np.ndarray, rotate: np.ndarray):
    """List, packed signs, residual norm, and inner product of code and residual direction."""
    at = nearest(x, centres)
    residual = (x - centres[at]) @ rotate
    norm = np.linalg.norm(residual, axis=1)
    fit = np.abs(residual).sum(axis=1) / np.maximum(norm, 1e-30) / np.sqrt(x.shape[1])
    return at, np.packbits(residual > 0, axis=1), norm, np.where(norm > 0, fit, 1.0)


def bounds(q: np.ndarray, code: np.ndarray, norm: np.ndarray, fit: np.ndarray, centre: np.ndarray, rotate: np.ndarray):
    """Lower and upper bound of the inner product of each query with each row of a list."""
    dim = q.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    guess = ((q @ rotate).astype(np.float32) @ signs.T) / np.sqrt(dim) / fit
    off = EPSILON * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(dim - 1, 1))
    off = np.linalg.norm(q, axis=1)[:, None] * off + 1e-5
    base = (q @ centre)[:, None]
    return base + norm * (guess - off) - 1e-6, base + norm * (guess + off) + 1e-6


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed in order."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def search_block(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray,
                 fit: np.ndarray, centre: np.ndarray, rotate: np.ndarray, k: int, least: np.ndarray):
    """(query_id, vec_id, score) of the best k distinct ids of a block for each query, those that score at least ``least``."""
    order = np.argsort(vec_id, kind="stable")  # rows of one id side by side
    vec_id, x, code, norm, fit = vec_id[order], x[order], code[order], norm[order], fit[order]
    first = np.flatnonzero(np.r_[True, vec_id[1:] != vec_id[:-1]])
    low, high = bounds(q, code, norm, fit, centre, rotate)
    own = query_id[:, None] == vec_id[None, :]
    low[own], high[own] = -np.inf, -np.inf
    bar = least
    if len(first) < len(vec_id):
        low = np.maximum.reduceat(low, first, axis=1)  # an id reaches what its best row reaches
    if low.shape[1] > k:
        bar = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
    keep = (high >= bar[:, None]) & ~own
    # one matrix product rates what the codes leave; only what its rounding cannot part from the best k is summed in order
    some = np.flatnonzero(keep.any(axis=0))
    with np.errstate(all="ignore"):
        rated = np.where(keep[:, some], q @ x[some].T, -np.inf)
        size = np.linalg.norm(x[some], axis=1).max(initial=0.0)
        off = 4 * q.shape[1] * np.finfo(float).eps * size * np.linalg.norm(q, axis=1) + np.finfo(float).tiny
        group = np.flatnonzero(np.r_[True, vec_id[some][1:] != vec_id[some][:-1]][:len(some)])
        bar = least
        if len(group) > k:
            of_id = np.maximum.reduceat(rated, group, axis=1)
            bar = np.maximum(least, np.partition(of_id, len(group) - k, axis=1)[:, -k])
        keep[:, some] &= ~(rated < (bar - 2 * off)[:, None])  # not a number: left to the sums
    out = []
    for i in np.flatnonzero(keep.any(axis=1)):
        at = np.flatnonzero(keep[i])
        score = exact(x[at], q[i][None, :])
        best = np.lexsort((-score, vec_id[at]))
        best = best[np.r_[True, vec_id[at][best][1:] != vec_id[at][best][:-1]]]  # the best row of each id
        best = best[np.lexsort((vec_id[at][best], -score[best]))][:k]
        best = best[score[best] >= least[i]]  # the rest cannot be among the best k
        out.append((np.full(len(best), query_id[i]), vec_id[at][best], score[best]))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(c) for c in zip(empty, *out))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = 3, list_rows: int = 4000,
               max_lists: int = 4096, sample_rows: int = 20_000, row_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best ``k`` rows of ``vectors`` (vec_id,
    embedding) other than itself for each row of ``queries`` (same columns)."""
    spark = vectors.sparkSession

    def valid(x: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        fine = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
        return x.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))

    rows = valid(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.filter(F.size("embedding") == dim)
    asked = valid(queries).filter(F.size("embedding") == dim).distinct()
    share = min(1.0, sample_rows / count)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    drawn = sorted((r["vec_id"], r["embedding"]) for r in drawn.distinct().limit(2 * sample_rows).collect())
    sample = np.array([e for _, e in drawn], float) if drawn else np.zeros((1, dim))
    centres = kmeans(sample, min(max_lists, max(1, count // list_rows)))
    shared = spark.sparkContext.broadcast((centres, rotation(dim)))
    probes = min(probes, len(centres))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rotate = shared.value
        for b in batches:
            at, code, norm, fit = encode(matrix(b.column(1)), centres, rotate)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array(norm), pa.array(fit)], names=["vec_id", "embedding", "list", "code", "norm", "fit"])

    index = staged(rows.distinct().mapInArrow(coded, "vec_id long, embedding array<double>, list int, code binary, norm double, fit double"), "codes")
    # at most max_lists rows, one per list
    lists = index.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()
    reach = np.full(len(centres), -1.0)
    for r in lists:
        reach[r["list"]] = r["norm"]
    row_blocks = spark.createDataFrame([(r["list"], -(-r["n"] // row_block)) for r in lists], "list int, row_blocks int")

    def asking(first: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, _ = shared.value
            for b in batches:
                q = matrix(b.column(1))
                near = q @ centres.T
                near[:, reach < 0] = -np.inf
                probe = np.zeros(near.shape, bool)
                np.put_along_axis(probe, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if not first:
                    least = b.column(2).to_numpy(zero_copy_only=False)
                    probe = ~probe & (near + np.linalg.norm(q, axis=1)[:, None] * reach * (1 + 1e-9) + 1e-9 >= least[:, None])
                probe[:, reach < 0] = False
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([np.flatnonzero(p).astype(np.int32) for p in probe], pa.list_(pa.int32()))],
                    names=["vec_id", "embedding", "least", "lists"])
        return choose

    def meet(key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        centres, rotate = shared.value
        code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
        x = np.stack(own["embedding"].to_list())
        parts = [search_block(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_list()), own["vec_id"].to_numpy(), x, code,
                              own["norm"].to_numpy(), own["fit"].to_numpy(), centres[key[0]], rotate, k, part["least"].to_numpy())
                 for part in (ask.iloc[n:n + 128] for n in range(0, len(ask), 128))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts)))))

    def searched(ask: DataFrame, first: bool) -> DataFrame:
        """(query_id, vec_id, score): at most k distinct ids of each block for each query."""
        ask = ask.mapInArrow(asking(first), "vec_id long, embedding array<double>, least double, lists array<int>")
        ask = staged(ask.select("vec_id", "embedding", "least", F.explode("lists").alias("list")), "queries")
        blocks = staged(ask.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_blocks"))
                        .join(row_blocks, "list"), "blocks")  # at most max_lists rows
        own, asked = (x.join(F.broadcast(blocks), "list") for x in (index, ask))
        deal = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = ("row_blocks", "query_blocks")
        own = own.withColumn("rb", deal("row_blocks")).withColumn("qb", every("query_blocks")).drop(*dealt)
        asked = asked.withColumn("qb", deal("query_blocks")).withColumn("rb", every("row_blocks")).drop(*dealt)
        by = ("list", "rb", "qb")
        return staged(own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(
            meet, "query_id long, vec_id long, score double"), "found")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = searched(asked.withColumn("least", F.lit(float("-inf"))), True)
    kth = best(near).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = asked.join(kth, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    far = searched(rest, False)
    return best(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")


def op1_ann(vectors: DataFrame) -> DataFrame:
    x = vectors.select("vec_id", "embedding")
    return neighbours(x, x.filter(F.col("vec_id") % 20 == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
