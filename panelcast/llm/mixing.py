"""Mixing sources to target weights (DataFrame functions only).

Words are counted per source, a target is derived for each source, and each
document is emitted ``floor(rate)`` times plus one more copy when a hash of
its id, read as a number in [0, 1), lies below the fraction of the rate, where
``rate = target / size`` of its source.

The targets share ``total_share`` times all words in proportion to the weights
and stop at ``max_repeat`` times their source's words; what is above that is
shared again among the others by weight, until none is above.  That has a
closed form: in ascending order of limit / weight, the capped sources are a
prefix, and each other source gets its weight times what is left over the sum
of weights left.  Only the table of sources (one row each, summed before it is
shuffled) passes through that order.

Defined results: a null text has no words; a null source is a source of its
own, last in order; a source without words gets target 0 and its documents are
taken once for each whole repeat of rate 0, that is never; rows that share an
id share the coin; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, staged

WEIGHTS = (5, 2, 1)


def cycled_weights(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Weigh the sources, by code point and null last, with ``weights`` in turn."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")))


def source_targets(sizes: DataFrame, total_share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """Targets of (source, source_size, weight): adds ``target`` (double)."""
    limit = F.col("source_size") * max_repeat
    order = Window.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    x = sizes.withColumns({
        "limit": limit,
        "total": F.sum("source_size").over(everything) * F.lit(total_share),
        "limit_before": F.coalesce(F.sum(limit).over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(after)})
    # the level that a source and all later ones would share if all earlier ones were capped
    x = x.withColumn("level", (F.col("total") - F.col("limit_before")) / F.col("weight_left"))
    x = x.withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    # the first source that is not capped sets the level of all that follow
    x = x.withColumn("level", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(
        F.least(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return x.select("source", "source_size", target.alias("target"))


def coin(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits, from the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def with_copies(docs: DataFrame, seed: int = 42, weights: tuple = WEIGHTS, total_share: float = 1.5,
                max_repeat: int = 2) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` added
    (underscores go before a name that ``docs`` already has)."""
    size, source_size, target, copies, key = fresh(docs, "size", "source_size", "target", "copies", "r_source")
    x = docs.withColumn(size, n_words(F.col("text")))
    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    plan = staged(source_targets(cycled_weights(sizes, weights), total_share, max_repeat), "targets")
    plan = plan.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    x = x.join(plan, x["source"].eqNullSafe(plan[key]), "left").drop(key)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    whole = F.floor(rate)
    extra = (coin(F.col("doc_id"), seed) < rate - whole).cast("long")
    return x.withColumn(copies, whole + extra)


def op2_mixing(docs: DataFrame) -> DataFrame:
    out = with_copies(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_stage(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Each document as many times as the mix takes it, with the columns of ``docs``."""
    copies = fresh(docs, "size", "source_size", "target", "copies")[3]
    out = with_copies(docs, seed)
    return (out.filter(F.col(copies) > 0)
            .select(*[F.col(f"`{c}`") for c in docs.columns],
                    F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
tried AS (
  -- for each source: what the level would be if every source with a smaller limit per weight were capped
  SELECT a.source, a.source_size, a.weight,
         (SELECT 1.5 * sum(source_size) FROM s)
           - coalesce(sum(2 * b.source_size) FILTER (WHERE 2 * b.source_size / b.weight < 2 * a.source_size / a.weight), 0) AS budget,
         sum(b.weight) FILTER (WHERE 2 * b.source_size / b.weight >= 2 * a.source_size / a.weight) AS weights
  FROM s a CROSS JOIN s b GROUP BY ALL),
lvl AS (
  SELECT first(CAST(budget AS DOUBLE) ORDER BY 2 * source_size / weight) AS budget, first(weights ORDER BY 2 * source_size / weight) AS weights
  FROM tried WHERE CAST(budget AS DOUBLE) / weights * weight < 2 * source_size),
t AS (
  SELECT s.source, s.source_size,
         CASE WHEN lvl.budget IS NULL THEN CAST(2 * s.source_size AS DOUBLE)
              ELSE least(lvl.budget / lvl.weights * s.weight, CAST(2 * s.source_size AS DOUBLE)) END AS target
  FROM s CROSS JOIN lvl),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':42'), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
