"""Subword-bag embeddings with a linear softmax, trained in numpy.

A text is lower-cased and read as runs of letters; its subwords are the
character n-grams of each run with its two ends marked, hashed into a fixed
number of buckets.  A bag is the average of its subwords' embeddings, and class
logits are linear in that, so prediction needs one row of class scores per
bucket.  Everything per text is a few numpy operations on its code points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 17
BUCKETS = 1 << BITS
STEP, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one 0, with a 0
    at both ends; empty if the text has no letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _LETTER[0][c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if not keep.any():
        return np.empty(0, np.uint64)
    c = np.where(letter, c, 0)[keep]
    return np.r_[0, c].astype(np.uint64) if c[0] else c.astype(np.uint64)


def packed(texts: Iterable[str | None], most: int) -> list[bytes]:
    """The thinned codes of each text as bytes."""
    return [thinned(codes(t), most).astype("<u4").tobytes() for t in texts]


def unpacked(b: bytes) -> list[int]:
    return np.frombuffer(b, "<u4").tolist()


def grams(c: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and run number of each n-gram that does not cross the end of a run."""
    ends = np.cumsum(c == 0)
    h, buckets, runs = c + np.uint64(1), [], []
    for n in range(1, high + 1):
        if n > 1:
            if len(h) < 2:
                break
            h = h[:-1] * STEP + c[n - 1:]
        if n >= low:
            inside = c[:len(h)] != 0 if n == 1 else ends[n - 2:n - 2 + len(h)] == ends[:len(h)]
            buckets.append(((h[inside] ^ np.uint64(n)) * SPREAD >> np.uint64(64 - BITS)).astype(np.int64))
            runs.append(ends[:len(h)][inside] - 1)
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(runs)


class SubwordSoftmax:
    """Embeddings and softmax weights, trained jointly by stochastic gradient descent (AdaGrad steps)."""

    def __init__(self, classes: int, dim: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (dim, classes)).astype(np.float32)
        self.b = np.zeros(classes, np.float32)
        self.seen = np.zeros(BUCKETS, bool)
        self._ge = np.full(BUCKETS, 1e-6, np.float32)
        self._gw, self._gb = np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)

    def step(self, bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rate: float) -> None:
        """One step on bags given as (buckets, shares of the average)."""
        bucket, share = np.concatenate([b for b, _ in bags]), np.concatenate([s for _, s in bags]).astype(np.float32)
        size = np.array([len(b) for b, _ in bags])
        bag = np.repeat(np.arange(len(bags)), size)
        mean = np.add.reduceat(self.e[bucket] * share[:, None], np.r_[0, np.cumsum(size)[:-1]], axis=0)
        p = softmax(mean @ self.w + self.b)
        p[np.arange(len(label)), label] -= 1
        p /= len(label)
        grad_w, grad_b, grad_mean = mean.T @ p, p.sum(axis=0), p @ self.w.T
        order = np.argsort(bucket, kind="stable")
        first = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1]
        used = bucket[order][first]
        grad_e = np.add.reduceat((grad_mean[bag] * share[:, None])[order], first, axis=0)
        self._ge[used] += (grad_e**2).mean(axis=1)
        self._gw += grad_w**2
        self._gb += grad_b**2
        self.e[used] -= rate * grad_e / np.sqrt(self._ge[used])[:, None]
        self.w -= rate * grad_w / np.sqrt(self._gw)
        self.b -= rate * grad_b / np.sqrt(self._gb)
        self.seen[used] = True

    def table(self) -> np.ndarray:
        """Class scores of each bucket; a bucket never trained scores nothing."""
        return np.where(self.seen[:, None], self.e @ self.w, 0).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` ids of ``rows``, those with the least hash of the id, and the hash.

    Each task keeps its own least ids only, so what meets is a few numbers.
    """
    return rows.select(key, F.xxhash64(F.lit("sample"), key).alias("order")).distinct().orderBy("order", key).limit(limit)


def thinned(c: np.ndarray, most: int, block: int = 200) -> np.ndarray:
    """Evenly spaced blocks of a text's codes for learning; all of it if it has at most ``most``."""
    if len(c) <= most:
        return c
    starts = np.arange(0, len(c), block)[:: -(-len(c) // most)]
    return np.concatenate([np.r_[np.uint64(0), c[k:k + block], np.uint64(0)] for k in starts])
