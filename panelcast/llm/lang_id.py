"""Language ID: averaged hashed subword embeddings, linear softmax, calibrated rejection.

The classifier is fitted on the driver from at most ``sample_rows`` labelled
documents (a documented bound on all languages together), each represented by
its letters, evenly thinned to about ``sample_chars``.  Every language gives the
same number of documents, those with the least hashes of their ids, or all it
has if they are fewer, so that a rare one is learned too; of more than
``sample_rows`` languages the most frequent ones are learned.  A fifth is
set aside to fit the temperature that makes the scores probabilities and the
threshold below which a document is rejected.  Prediction reads every whole
text, in Arrow batches.

Defined results: a null text or one without letters is ``und`` with score 0
and is rejected; documents with null ids are never learned from; without any
labelled document everything is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import subwords as S
from .common import bound_batches, fresh, staged

LOW, HIGH = 1, 4
NONE = "und"


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _bag(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket, count = np.unique(S.grams(c, LOW, HIGH)[0], return_counts=True)
    return bucket, count / count.sum()


def train(texts: list[np.ndarray], labels: list[str], epochs: int = 6, batch: int = 32, least_steps: int = 300, most_rejecting: float = 0.4,
          seed: int = 7) -> LangModel | None:
    """Fit on codes of texts; every fifth text only calibrates."""
    known = [(c, y) for c, y in zip(texts, labels) if len(c)]
    if not known:
        return None
    langs = sorted({y for _, y in known})
    label = np.array([langs.index(y) for _, y in known])
    bags = [_bag(c) for c, _ in known]
    model, rng = S.SubwordSoftmax(len(langs), seed=seed), np.random.default_rng(seed)
    calibrate = np.arange(len(known)) % 5 == 4
    fit = np.flatnonzero(~calibrate)
    epochs = max(epochs, -(-least_steps * batch // len(fit)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            model.step([bags[k] for k in part], label[part], 0.1 / (1 + 6 * epoch / epochs))
    table = model.table()
    logits = np.array([table[b].T @ s for b, s in bags]) + model.b
    judged = np.flatnonzero(calibrate) if calibrate.sum() >= 20 else np.arange(len(known))
    temperature = min((0.1, 0.2, 0.5, 1, 2, 5), key=lambda t: -np.log(
        np.maximum(S.softmax(logits[judged] / t)[np.arange(len(judged)), label[judged]], 1e-9)).mean())
    # short cuts of the set-aside texts, judged like whole texts, set the threshold: a text is rejected
    # if its score is lower than what all but one in a thousand rightly recognised cuts of 20 letters reach, and
    # never above `most_rejecting`: a text that is short or holds two languages is no junk
    cuts = [(c[k:k + 20], y) for c, y in (known[k] for k in judged) for k in range(0, min(len(c), 400), 20)]
    cuts = [(_bag(np.r_[np.uint64(0), c, np.uint64(0)]), langs.index(y)) for c, y in cuts if c.any()]
    scores = S.softmax((np.array([table[b].T @ s for (b, s), _ in cuts]) + model.b) / temperature)
    right = scores.argmax(axis=1) == np.array([y for _, y in cuts])
    threshold = min(most_rejecting, float(np.quantile(scores.max(axis=1)[right], 0.001))) if right.any() else 0.0
    return LangModel(langs, table, model.b, float(temperature), threshold)


def water_level(counts: list[int], total: int) -> int:
    """The largest bound on each count that keeps the sum within ``total``; at least 1."""
    left = total
    for k, n in enumerate(sorted(counts)):
        level = left // (len(counts) - k)
        if n > level:
            return max(1, level)
        left -= n
    return max(counts, default=1)


def sample_of_languages(rows: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, lang): the least hashes of each language, at most ``sample_rows`` in all.

    The counts give each language a bar that a few more than its share pass, so
    only those rows, however many a language has, meet to be ranked.
    """
    spark = rows.sparkSession
    ids = staged(rows.select("doc_id", "lang", F.xxhash64(F.lit("sample"), "doc_id").alias("order")).distinct(), "lang-ids")
    # at most sample_rows rows, one per language
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    level = water_level([r["n"] for r in counts], sample_rows)
    some = level + 8 * level**0.5 + 50
    bars = [(r["lang"], 2**63 - 1 if some >= r["n"] else int(some / r["n"] * 2**64) - 2**63) for r in counts]
    bars = spark.createDataFrame(bars, "of string, bar long")
    few = ids.join(F.broadcast(bars), (F.col("lang") == F.col("of")) & (F.col("order") <= F.col("bar")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= level).select("doc_id", "lang")


def fit(docs: DataFrame, sample_rows: int = 2000, sample_chars: int = 4000) -> LangModel | None:
    """Learn from text and non-null lang of the documents that may be learned from."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter(
        S.learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = sample_of_languages(rows, sample_rows)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "lang": x["lang"], "codes": S.packed(x["text"], sample_chars)})

    # at most sample_rows ids are broadcast; rows that share one are one row of the sample
    sample = (rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "text", "lang")
              .mapInPandas(thin, "doc_id long, lang string, codes binary").groupBy("doc_id", "lang").agg(F.min("codes").alias("codes")))
    got = sorted((r["doc_id"], r["lang"], S.unpacked(r["codes"])) for r in sample.collect())
    order = np.random.default_rng(11).permutation(len(got))
    return train([np.array(got[k][2], np.uint64) for k in order], [got[k][1] for k in order])


def with_language(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` added (underscores
    go before a name that ``docs`` already has)."""
    bound_batches(docs.sparkSession)
    names = fresh(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, rejected boolean>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            rows = []
            for text in texts:
                c = S.codes(text) if m else ()
                if not len(c):
                    rows.append((NONE, 0.0, True))
                    continue
                mean = m.table[S.grams(c, LOW, HIGH)[0]].mean(axis=0, dtype=np.float64)
                p = S.softmax((mean + m.bias) / m.temperature)
                k = int(p.argmax())
                rows.append((m.langs[k], float(p[k]), bool(p[k] < m.threshold)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    found, = fresh(docs, "r_found")
    out = docs.withColumn(found, predict(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns],
                      *[F.col(f"{found}.{f}").alias(n) for f, n in zip(("lang_pred", "score", "rejected"), names)])


def op5_lang_id(docs: DataFrame) -> DataFrame:
    x = docs.select("doc_id", "text", "lang")
    out = with_language(x.select("doc_id", "text"), fit(x))
    return out.select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def lang_id_stage(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all columns."""
    rejected = fresh(docs, "lang_pred", "score", "rejected")[2]
    return with_language(docs, fit(docs)).filter(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])
