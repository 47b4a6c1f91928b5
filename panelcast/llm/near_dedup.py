"""MinHash near-dedup: one-permutation hashing, optimal densification, star-shaped edges.

1. One pass over the texts gives every document the size of its set of distinct
   word shingles, a 128-bit fingerprint of the set, and band keys of a
   one-permutation MinHash signature (each shingle falls in one bin, a bin keeps
   its least value, an empty bin borrows from a bin chosen by a hash of its
   number and the attempt).
2. Documents with equal sets are one class; only its smallest id goes on.
3. Members of a bucket (a shared band key) are joined to one centre, not to each
   other.  The centre is the member that meets most others over all its buckets,
   so that the original of a family of copies tends to be chosen.  Each edge is
   confirmed on the full sets.
4. Where a bucket still holds more than one component, the pairs across its
   components are looked at, and only those that can reach the threshold are
   made: shingles that no other document of such buckets holds cannot be shared,
   which bounds the intersection, and sizes must agree with that bound.  The
   bound is exact, so no link of a bucket is lost and families of loosely
   similar texts do not become all pairs.
5. Components by alternating large-star and small-star steps, each written.

With 26 bands of 5 values, two sets of similarity 0.85 share no bucket with
probability (1 - 0.85**5)**26, about 2.4e-7; at 0.80, the threshold of the
pipeline's stage, with probability 3.3e-5.

Defined results: a document without words has an empty set, is linked with
nothing and is its own component; a null id stands below every other id; rows
that share an id are one node, with the links of all of them; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bound_batches, fresh, shuffles_released, staged

ROWS, BANDS = 5, 26
#: Similarity at which the pipeline's stage links documents; the query op9 links at 85.
STAGE_PERCENT = 80
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashes of words that a Python worker keeps, about 10 MB.
CACHED_WORDS = 50_000
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    for w in words:
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([_WORDS[w] for w in words], np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * M1 + h[k:k + n])
    return np.unique(out)


def _donors(bins: int, tries: int = 64) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(tries, dtype=np.uint64)
    return (_mix(at * M1) % np.uint64(bins)).astype(np.int64)


DONORS = _donors(ROWS * BANDS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a non-empty set, densified."""
    bins = len(DONORS)
    mixed = _mix(shingles ^ M1)
    where = (mixed % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((mixed, where))
    where, mixed = where[order], mixed[order]
    first = np.r_[True, where[1:] != where[:-1]]
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[where[first]], full[where[first]] = mixed[first], True
    empty = np.flatnonzero(~full)
    for t in range(DONORS.shape[1]):
        if not len(empty):
            break
        donor = DONORS[empty, t]
        ok = full[donor]
        sig[empty[ok]] = sig[donor[ok]]
        empty = empty[~ok]
    filled = np.flatnonzero(full)  # what all attempts missed takes the next full bin
    sig[empty] = sig[filled[np.searchsorted(filled, empty) % len(filled)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    values = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * M1 + values[:, k])
    return out


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, th, n, f1, f2, bands): size, fingerprint and band keys of each document's set."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), width)
                f = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                rows.append((doc_id, len(s), int(f[0]), int(f[1]),
                             band_keys(signature(s)).view(np.int64) if len(s) else None))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(
        sketch, "id long, n long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, shingles) of each document."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, schema.types[1])], schema=schema)

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(collect, "id long, shingles array<long>")


# -- components -------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b); component is the least node."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = staged(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(now)


# -- links --------------------------------------------------------------------------
def _linked(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    x = x.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return x.filter(_linked(shared, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 85) -> DataFrame:
    """(id, n, component) of each row of ``docs``; a null id is ``NULL_ID`` here.

    Every step is written and read back, and gives its shuffle files up at once: the disk in
    use is that of the largest step, not of all of them.
    """
    bound_batches(docs.sparkSession)
    with shuffles_released(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, width, percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).alias("text"))
    every = staged(sketches(base, width), "sketches")
    classes = staged(every.filter("n > 0").groupBy("f1", "f2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(keyed.join(sizes, "key"), "members")
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    members = staged(members.drop("size").join(met, "id"), "members")
    # sets of the documents that share a bucket
    # the ids grow with the documents: the same plan at every size
    sets = staged(shingle_sets(base.join(met.select("id").hint("merge"), "id", "left_semi"), width), "sets")

    def sizes_agree(a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    centre = members.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("neg"), "n")).alias("c")).select(
        "key", (-F.col("c.neg")).alias("a"), F.col("c.n").alias("n_a"))
    spokes = (members.join(centre, "key").filter((F.col("id") != F.col("a")) & sizes_agree("n", "n_a"))
              .select("a", F.col("id").alias("b")).distinct())
    links = staged(confirmed(spokes, sets, percent), "links")
    found = components(links)

    # buckets that still hold more than one component
    labelled = members.join(found, members["id"] == found["node"], "left").select(
        "key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
        "low <> high").select("key")
    left = staged(labelled.join(split, "key"), "left")
    # shingles that a second document of these buckets holds
    held = sets.join(left.select("id").distinct(), "id").select("id", F.explode("shingles").alias("s"))
    common = held.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1").select("s")
    can = held.join(common, "s").groupBy("id").agg(F.count("*").alias("can"))
    left = left.join(can, "id").filter(100 * F.col("can") >= percent * F.col("n"))
    # a pair is made in the first band it shares only: no earlier key is the same
    left = left.join(classes.select("id", "bands"), "id").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band")))
    left = staged(left.drop("bands", "band"), "left")
    # a pair of sizes n and m shares at least percent / (100 + percent) of n + m
    step = math.log(1.08)
    size_class = lambda c: F.floor(F.log(c.cast("double")) / F.lit(step))
    most = F.least(100 * F.col("n") / percent, (100 + percent) * F.col("can") / percent - F.col("n"))
    least = percent * F.col("n") / 100
    probes = left.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("can").alias("can_a"),
                         F.col("component").alias("in_a"), F.col("earlier").alias("earlier_a"),
                         F.explode(F.sequence(size_class(least) - 1, F.greatest(size_class(least) - 1, size_class(most) + 1))).alias("class"))
    targets = left.withColumn("class", size_class(F.col("n")))
    pairs = probes.join(targets, ["key", "class"]).filter(
        (F.col("a") < F.col("id")) & (F.col("in_a") != F.col("component")) & sizes_agree("n", "n_a")
        & ((100 + percent) * F.least("can", "can_a") >= percent * (F.col("n") + F.col("n_a")))
        & ~F.arrays_overlap("earlier", "earlier_a")).select("a", F.col("id").alias("b")).distinct()
    more = staged(confirmed(pairs, sets, percent), "links")
    found = components(links.unionByName(more))

    node = classes.select("f1", "f2", F.col("id").alias("rep"))
    node = node.join(found, node["rep"] == found["node"], "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component"))
    # two classes of one id are one node
    out = every.join(staged(node, "nodes"), ["f1", "f2"], "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def op9_near_dedup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    doc_id = F.nullif("id", F.lit(NULL_ID))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif("component", F.lit(NULL_ID)).alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"))


def _one_row_a_set(rows: DataFrame, rid: str) -> DataFrame:
    """One row, the one with the least hash, of each id (``rid``) and set; all rows with a null id and no words."""
    @F.pandas_udf("struct<n long, f1 long, f2 long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(None if t is None else bytes(t)) for t in texts]
        marks = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in sets]
        return pd.DataFrame({"n": np.array([len(x) for x in sets], np.int64), "f1": np.array([m[0] for m in marks], np.int64),
                             "f2": np.array([m[1] for m in marks], np.int64)})

    columns = [F.col(f"`{c}`") for c in rows.columns if c != rid]
    found, salt, row = fresh(rows, "r_found", "r_salt", "r_row")
    alone = F.col("doc_id").isNull() & (F.col(f"{found}.n") == 0)
    x = rows.withColumn(found, sketch(F.col("text").cast("binary")))
    x = x.withColumn(salt, F.when(alone, F.monotonically_increasing_id()))
    return x.groupBy(rid, found, salt).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row)).select(f"{row}.*")


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of their group, with all columns; groups link at ``STAGE_PERCENT``.

    Rows with a null id are documents of their own, told apart by their text and
    below every other id (numbers under -2**62 stand for them).  Of rows that
    share an id and a set one stays; rows of one id with different sets all
    stay, and so do rows with a null id and no words.
    """
    rid, of, times = fresh(docs, "r_id", "r_of", "r_times")
    unnamed = F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    named = docs.withColumn(rid, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    out = near_duplicates(named, id_col=rid, percent=STAGE_PERCENT)
    kept = out.groupBy(F.col("id").alias(of)).agg(F.max(F.col("id") == F.col("component")).alias("kept"), F.count("*").alias(times))
    kept = staged(kept.filter("kept").drop("kept"), "kept")

    def among(which: Column) -> DataFrame:
        return named.join(kept.filter(which), F.col(rid) == F.col(of), "left_semi")

    return among(F.col(times) == 1).drop(rid).unionByName(_one_row_a_set(among(F.col(times) > 1), rid))
