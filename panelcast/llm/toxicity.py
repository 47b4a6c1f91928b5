"""Toxicity: subword-bag embeddings averaged into a linear softmax, over short windows.

A few hostile words in a long text vanish in the average of the whole text, so
the bags are windows of ``WINDOW`` consecutive words and a text scores as its
most hostile windows.  The label of a document says nothing of its windows;
training alternates between choosing the windows that a toxic document owes its
label to and gradient steps on those against windows of clean documents, the
most hostile ones among them.  The first choice rests on how much more often
toxic documents hold a word's n-grams.  Misspelled and unseen words share the
n-grams of known ones.

The classifier is fitted on the driver from at most ``sample_rows`` documents
of each label (a documented bound; the least hashes of the ids), each evenly
thinned to about ``sample_chars`` letters; a fifth of them calibrates the
score.  Prediction reads every whole text, in Arrow batches.

Defined results: a null or empty text, or one without letters, scores as a
clean one; documents without a label, with a null label or a null id are not
learned from; of several labels of one document the largest counts; without
both labels every score is the share of label 1 (0 if there is none); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords as S

LOW, HIGH = 3, 5
WINDOW = 4
THRESHOLD = 0.7


@dataclass
class ToxicModel:
    table: np.ndarray
    bias: float
    scale: float
    shift: float
    base: float


def hostility(word_scores: np.ndarray) -> float:
    """The largest average over ``WINDOW`` consecutive words (all of a shorter text)."""
    if not len(word_scores):
        return 0.0
    total = np.r_[0.0, np.cumsum(word_scores, dtype=np.float64)]
    n = min(WINDOW, len(word_scores))
    return float(((total[n:] - total[:-n]) / n).max())


@dataclass
class Words:
    """The distinct words of the training texts, with the buckets of each."""

    flat: np.ndarray
    first: np.ndarray
    texts: list[np.ndarray]  # word numbers

    @staticmethod
    def of(texts: list[np.ndarray]) -> Words:
        where: dict[bytes, int] = {}
        numbers = []
        for c in texts:
            ends = np.flatnonzero(c == 0)
            runs = [c[a + 1:b].tobytes() for a, b in zip(ends[:-1], ends[1:]) if b > a + 1]
            numbers.append(np.fromiter((where.setdefault(r, len(where)) for r in runs), np.int64, len(runs)))
        zero = np.zeros(1, np.uint64).tobytes()
        c = np.frombuffer(zero + b"".join(r + zero for r in where), np.uint64)
        bucket, word = S.grams(c, LOW, HIGH)
        order = np.argsort(word, kind="stable")
        return Words(bucket[order], np.searchsorted(word[order], np.arange(len(where) + 1)), numbers)

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.flat[self.first[w]:self.first[w + 1]] for w in words]
        return np.concatenate(parts), np.concatenate([np.full(len(p), 1 / len(p) / len(parts)) for p in parts])


def train(texts: list[np.ndarray], labels: list[int], rounds: int = 4, per_doc: int = 3, batch: int = 256,
          least_steps: int = 60, seed: int = 7) -> ToxicModel:
    """Fit on codes of texts; every fifth of each label only calibrates."""
    label = np.array(labels, int)
    base = float(label.mean()) if len(label) else 0.0
    words = Words.of(texts)
    calibrate = np.zeros(len(label), bool)
    for y in (0, 1):
        own = np.flatnonzero(label == y)
        calibrate[own[4::5]] = True
    some = np.array([len(w) > 0 for w in words.texts], bool)
    toxic, clean = (np.flatnonzero((label == y) & ~calibrate & some) for y in (1, 0))
    if not len(toxic) or not len(clean):
        share = min(max(base, 1e-9), 1 - 1e-9)
        return ToxicModel(np.zeros((S.BUCKETS, 1), np.float32), 0.0, 0.0, float(np.log(share / (1 - share))), base)
    model, rng = S.SubwordSoftmax(2, seed=seed), np.random.default_rng(seed)

    # log odds of the buckets, by how many documents of each label hold them
    held = np.ones((2, S.BUCKETS))
    for y, which in ((1, toxic), (0, clean)):
        for k in which:
            held[y, np.unique(words.bag(np.unique(words.texts[k]))[0])] += 1
    odds = np.log(held[1] / (len(toxic) + 2)) - np.log(held[0] / (len(clean) + 2))

    def by_word(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[words.flat], words.first[:-1]) / np.diff(words.first)

    scores = by_word(odds)

    def windows(k: int, most: int, threshold: float | None = None) -> list[np.ndarray]:
        """Windows of a document around its most hostile words."""
        w = words.texts[k]
        own = scores[w]
        top = np.argsort(-own, kind="stable")[:most]
        if threshold is not None:
            top = np.r_[top[:1], top[1:][own[top[1:]] > threshold]]
        return [w[max(0, min(t - int(rng.integers(WINDOW)), len(w) - WINDOW)):][:WINDOW] for t in top]

    for r in range(rounds):
        # what clean documents reach at most tells hostile words from the rest
        clean_most = np.quantile([scores[words.texts[k]].max() for k in clean], 0.99)
        picked = [(w, 1) for k in toxic for w in windows(k, per_doc, clean_most)]
        hard = [(w, 0) for k in clean for w in windows(k, 2)]
        plain = [(words.texts[k][at:at + WINDOW], 0) for k in np.r_[clean, clean]
                 for at in [int(rng.integers(max(1, len(words.texts[k]) - WINDOW + 1)))]]
        every = picked * max(1, len(hard) // max(1, 2 * len(picked))) + hard + plain
        parts = max(1, len(every) // batch)
        for part in (x for _ in range(-(-least_steps // parts)) for x in np.array_split(rng.permutation(len(every)), parts)):
            model.step([words.bag(every[k][0]) for k in part], np.array([every[k][1] for k in part]), 0.2 / (1 + r))
        table = model.table()
        scores = by_word(table[:, 1] - table[:, 0])
    table = model.table()
    bias = float(model.b[1] - model.b[0])
    got = np.array([hostility(scores[w]) if len(w) else 0.0 for w in words.texts]) + bias
    judged = np.flatnonzero(calibrate) if len(set(label[calibrate])) == 2 and (label[calibrate] == 1).sum() >= 5 else np.arange(len(label))
    scale, shift = _platt(got[judged], label[judged])
    return ToxicModel((table[:, 1:] - table[:, :1]).astype(np.float32), bias, scale, shift, base)


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift that make logistic(scale * x + shift) fit the labels (Newton steps, smoothed labels)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, [(d * x).sum() + 1e-6 * a, d.sum() + 1e-6 * b])
        move = np.clip(move, -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_chars: int = 20_000) -> ToxicModel:
    """Learn from the labelled documents that may be learned from."""
    marks = (labels.select("doc_id", "toxic").filter(S.learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    marks = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = [S.bounded_sample(marks.filter(F.col("toxic") == y), "doc_id", sample_rows).withColumn("toxic", F.lit(y))
           for y in (0, 1)]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "toxic": x["toxic"], "codes": S.packed(x["text"], sample_chars)})

    # at most 2 * sample_rows ids are broadcast; rows that share one are one row of the sample
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    sample = (texts.join(chosen, "doc_id").select("doc_id", "text", "toxic")
              .mapInPandas(thin, "doc_id long, toxic int, codes binary").groupBy("doc_id", "toxic").agg(F.min("codes").alias("codes")))
    got = sorted((r["doc_id"], r["toxic"], S.unpacked(r["codes"])) for r in sample.collect())
    order = np.random.default_rng(11).permutation(len(got))
    return train([np.array(got[k][2], np.uint64) for k in order], [got[k][1] for k in order])


def word_scores(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Average score of the subwords of each word of a text."""
    bucket, word = S.grams(c, LOW, HIGH)
    return np.bincount(word, table[bucket]) / np.bincount(word)


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        table = m.table[:, 0]
        for texts in parts:
            out = []
            for text in texts:
                c = S.codes(text)
                x = m.bias + (hostility(word_scores(c, table)) if len(c) else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(m.scale * x + m.shift, -30, 30))))
            yield pd.Series(out, dtype="float64")

    return docs.select("doc_id", score(F.col("text")).alias("score"))


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
