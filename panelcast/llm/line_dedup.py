"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only).

A run is a Parquet table sorted by line hash with one row per key: the hash
(two 64-bit halves), the number of documents that hold the key and the largest
id among them.  Each batch of documents is anti-joined against the keys that
the runs have already settled (enough documents, and a holder with a larger
id); only what is left is aggregated and added as a run of its own at level 0.
When a level holds ``fanout`` runs they are merged into one run of the next
level, so a key is rewritten once per level and a batch meets few runs.

Batches go in descending order of the ids, so that a very common line is
settled by the first batches and its later occurrences are never added again.
The result does not depend on the order: an occurrence is left out only when
it cannot change the verdict.

Defined results: a null or empty text is one empty line; a null id stands
below every other id; rows with the same id are one document, so a line that
they repeat counts once; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, NULL_ID, ascii_lower, fresh, release, staged

KEY = ("h1", "h2")
SALT = 7919


def line_keys(text: Column) -> Column:
    """The key of each line, in order: blanks stripped at both ends, A-Z lower-cased."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SALT), key).alias("h2")]


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, keeper) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch of (h1, h2, id) against the runs; add the rest as a run."""
        for run in self.runs():
            done = run.filter(F.col("n_docs") >= self.min_docs).select(
                F.col("h1").alias("r1"), F.col("h2").alias("r2"), "keeper")
            batch = batch.join(done, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))
                               & (F.col("id") <= F.col("keeper")), "left_anti")
        run = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        self._put(run, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(staged(run.sortWithinPartitions(*KEY), f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._merged(old), level + 1)
            for r in old:
                release(self.spark, r)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(
            F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def frequent(self) -> DataFrame:
        """Keys held by at least ``min_docs`` documents, with the largest id that holds each."""
        return self._merged(self.runs()).filter(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3,
                min_chars: int = 20, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines whose key is frequent, except in the largest id that holds it.

    Returns every row and column of ``docs`` with the columns ``n_lines``,
    ``n_dropped`` (long) and ``kept_text`` added (underscores go before a name
    that ``docs`` already has).
    """
    spark = docs.sparkSession
    n_lines, n_dropped, kept_text, rid, rth, drop, lines = fresh(
        docs, "n_lines", "n_dropped", "kept_text", "r_id", "r_th", "r_drop", "r_lines")
    text = F.col(text_col)
    doc = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.xxhash64(text).alias("th"), line_keys(text).alias("keys"))

    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    low, high = low or 0, high or 0
    width = (high - low) // batches + 1
    # the differences of ids need not fit into a long: ids are compared with the batches' bounds instead
    bounds = [high - k * width for k in range(1, batches)]
    batch_no = reduce(lambda a, b: a + b, [(F.col("id") <= b).cast("int") for b in bounds if b >= -2**63], F.lit(0))
    batch_no = F.when(F.col("id") == NULL_ID, batches - 1).otherwise(batch_no)
    occurrences = (doc.select("id", F.explode(F.array_distinct("keys")).alias("key"))
                   .filter(F.char_length("key") >= min_chars)
                   .select(*_hashes(F.col("key")), "id", batch_no.alias("batch")))
    occurrences = staged(occurrences, "lines", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        # rows that share an id are one document
        runs.add(occurrences.filter(F.col("batch") == b).select(*KEY, "id").distinct())
    frequent = staged(runs.frequent(), "frequent")
    for r in [*runs.runs(), occurrences]:
        release(spark, r)
    hits = (doc.select("id", "th", F.posexplode("keys").alias("at", "key"))
            .filter(F.char_length("key") >= min_chars)
            .select(*_hashes(F.col("key")), "id", "th", "at")
            .join(frequent, list(KEY)).filter(F.col("id") != F.col("keeper"))
            .groupBy(F.col("id").alias(rid), F.col("th").alias(rth)).agg(F.collect_set("at").alias(drop)))
    out = docs.join(hits, (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == hits[rid])
                    & (F.xxhash64(docs[text_col]) == hits[rth]), "left")
    out = out.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(n_dropped),
        F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit("")))
        .otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n")).alias(kept_text))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """Digest of :func:`dedup_lines` with its default parameters."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """Every document with the text that is left; ``n_chars`` follows the text where lines went."""
    n_lines, n_dropped, kept_text = fresh(docs, "n_lines", "n_dropped", "kept_text")
    out = dedup_lines(docs)
    changed = F.col(n_dropped) > 0
    new = {"text": F.when(changed, F.col(kept_text)).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.char_length(kept_text).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, part[i] AS line,
         translate(trim(part[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents))),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT l.*, f.keeper IS NOT NULL AND l.doc_id <> f.keeper AS dropped
  FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
