"""Quality rules: robust multivariate outliers per language and source (DataFrame functions only).

Each document has a vector of transformed statistics.  For each (language,
source) the minimum-covariance-determinant estimate is found by concentration
steps: distances under the present estimate, the ``share`` of least distances,
mean and covariance of those, again.  A step is one aggregation: rows are
summed per (language, source, bin of the distance), so what is shuffled is a
few moments per bin however many documents a source holds, and the bins up to
the wanted share are added up.  Moments are shrunk towards those of the
language with the weight of ``prior`` rows and variances have a floor, so small
or constant groups stay regular.  The start is coordinate-wise: medians and
interquartile ranges.  Documents are rejected by their Mahalanobis distance.

Defined results: a null text has no words and fails the base rules, as does
every text of fewer than ``MIN_WORDS`` words; documents that fail them take no
part in the estimates; null languages and sources are groups of their own; rows
that share an id are judged each on their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, BLANKS, staged

MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("f1", "f2", "f3", "f4", "f5")
#: Least standard deviation of each feature.
FLOORS = (0.3, 0.1, 0.3, 0.3, 0.1)
P = len(FEATURES)


# -- statistics -------------------------------------------------------------------
def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", "lang", "source", text.alias("text"))
    x = x.withColumn("words", F.when(F.trim("text", F.lit(BLANKS)) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.trim("text", F.lit(BLANKS)), f"{BLANK}+", -1)))
    x = x.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda y: F.trim(y, F.lit(BLANKS)) != ""))
    w = F.col("words")
    x = x.withColumn("windows", F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(w[k], w[k + 1], w[k + 2]))))
    x = x.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    x = x.withColumn("by_hash", F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))
    s = F.col("by_hash")

    def again(y: Column, k: Column) -> Column:
        return ((k > 0) & (F.get(s, k - 1)["h"] == y["h"])) | F.coalesce(F.get(s, k + 1)["h"] == y["h"], F.lit(False))

    x = x.withColumn("found", F.sort_array(F.transform(F.filter("by_hash", again), lambda y: y["k"])))
    start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
    covered = F.aggregate("found", start, lambda a, k: F.struct(
        (a["total"] + F.least(F.lit(3), k - a["last"])).alias("total"), k.alias("last")))["total"]
    return x.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns({
        "f1": F.log1p(n), "f2": F.log(chars / n), "f3": F.log1p(100 * F.col("n_symbols") / chars),
        "f4": F.log1p(100 * F.col("n_dup_lines") / n), "f5": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n)))})


# -- chi-square -------------------------------------------------------------------
def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom (series of the incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """What a covariance of the ``share`` of least distances is multiplied by for normal data."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


# -- estimates ----------------------------------------------------------------------
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _distance(x: DataFrame, estimate: DataFrame) -> DataFrame:
    """``x`` with ``d2``, the squared distance under its group's mean and Cholesky factor."""
    e = estimate.withColumnsRenamed({"lang": "e_lang", "source": "e_source"})
    x = x.join(e, x["lang"].eqNullSafe(e["e_lang"]) & x["source"].eqNullSafe(e["e_source"]), "left")
    # forward substitution
    for i in range(P):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        x = x.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0))
    return x.withColumn("d2", d2).drop("e_lang", "e_source", *e.columns[2:], *[f"y{i}" for i in range(P)])


def _cholesky(x: DataFrame) -> DataFrame:
    """Factor l of the covariance c (columns cij) of each group."""
    for j in range(P):
        under = F.col(f"c{j}{j}")
        for k in range(j):
            under = under - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        x = x.withColumn(f"l{j}{j}", F.sqrt(F.greatest(under, F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            x = x.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return x.select("lang", "source", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def start(x: DataFrame) -> DataFrame:
    """Medians and interquartile ranges per group, as an estimate without correlations."""
    q = x.groupBy("lang", "source").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in FEATURES])
    q = q.withColumns({f"m{i}": F.col(f)[1] for i, f in enumerate(FEATURES)})
    spread = {f"c{i}{i}": ((F.col(f)[2] - F.col(f)[0]) / 1.349) ** 2 for i, f in enumerate(FEATURES)}
    return _cholesky(q.withColumns(spread | {f"c{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j}))


def concentrate(x: DataFrame, estimate: DataFrame, share: float, prior: int) -> DataFrame:
    """One concentration step: the estimate from the ``share`` of least distances of each group."""
    bins = _distance(x, estimate).withColumn("bin", F.floor(8 * F.log2(F.col("d2") + 1e-6)))
    moments = {f"s{i}": F.sum(f) for i, f in enumerate(FEATURES)}
    moments |= {f"s{i}{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in PAIRS}
    bins = bins.groupBy("lang", "source", "bin").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in moments.items()])
    group = Window.partitionBy("lang", "source")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumns({"before": before, "all": F.sum("n").over(group)}).filter(F.col("before") < share * F.col("all"))
    own = near.groupBy("lang", "source").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in moments])
    # shrink towards the language: its moments, weighing as much as `prior` rows
    by_lang = Window.partitionBy("lang")
    weight = F.lit(float(prior)) / F.sum("n").over(by_lang)
    own = own.withColumns({k: F.col(k) + weight * F.sum(k).over(by_lang) for k in ("n", *moments)})
    own = own.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    own = own.withColumns({f"c{i}{j}": F.lit(consistency(share)) * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
                           for i, j in PAIRS})
    return _cholesky(own)


def judged(docs: DataFrame, share: float = 0.75, steps: int = 3, prior: int = 20, reject: float = 1e-9) -> DataFrame:
    """Statistics of each document with ``base_failed``, ``distance`` (null if the base
    rules failed) and ``kept``."""
    stats = staged(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    x = features(stats.filter(~F.col("base_failed")))
    estimate = staged(start(x), "estimate")
    for _ in range(steps):
        estimate = staged(concentrate(x, estimate, share, prior), "estimate")
    cut = chi2_quantile(1 - reject, P)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    out = _distance(features(stats), estimate).drop(*FEATURES)
    return out.withColumns({"distance": F.sqrt(d2), "kept": ~F.col("base_failed") & F.coalesce(d2 <= cut, F.lit(True))}).drop("d2")


def op10_quality(docs: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "distance")


#: The columns that SQL can express, for tests.
STATISTICS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, w FROM w GROUP BY doc_id, w HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS at
        FROM (SELECT w.doc_id, w.i, unnest([0, 1, 2]) AS k FROM w JOIN twice USING (doc_id, w))),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
       coalesce(rep.n, 0) AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(words) AS base_failed
FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
"""
