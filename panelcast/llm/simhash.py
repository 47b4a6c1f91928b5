"""SimHash near-dedup: 64-bit fingerprints, covering locality-sensitive hashing.

1. One pass over whole texts gives every row its fingerprint: a bit is 1 if it is
   set in over half of the 64-bit hashes of the row's word shingles.
2. Rows of one fingerprint are one class; classes are what follows works on.
3. ``covering_masks`` deals every bit a vector over GF(2); each non-zero vector of
   that space is one table, whose mask keeps the bits with a dual product of 1.
   However up to ``radius`` bits differ, some vector is orthogonal to all of
   theirs, so that its mask keeps none of them: the pair collides in that table,
   with certainty.
4. Fingerprints that share a bucket of a table are not compared in pairs.  Those
   that differ only in bits which the mask drops, and in at most ``radius`` of
   them, meet at a point half-way.  Each fingerprint goes to the points that are
   reached by changing at most half the radius of the bits dropped where it
   collides, and is linked there to the least one.  Whatever meets at a point is
   within the radius, so links are exact, and their number grows in proportion to
   the fingerprints, however many share a bucket.
5. Components by alternating large-star and small-star steps.

Defined results: null texts and texts without words have the fingerprint zero and
are linked like any other; texts shorter than a shingle are one shingle; rows that
share an id are one document (their classes are linked); rows with a null id are
linked by their fingerprints alone and are never a component's id (a component
without ids has a null one); an empty table gives an empty result.  Other columns
of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .near_dedup import components

BITS, RADIUS, WIDTH, SEED = 64, 2, 3, 42
#: Hashes whose bits are counted at once.
AT_ONCE = 65_536


# -- fingerprints -----------------------------------------------------------------------
def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of a text, unsigned; zero without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - width].tolist()]
    stops = (ends[width - 1:] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), AT_ONCE):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[k:k + AT_ONCE], stops[k:k + AT_ONCE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, fp) of each row; ``fp`` holds the 64 bits as a long."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(add, "id long, fp long")


# -- covering -----------------------------------------------------------------------------
def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any two words within the radius agree on the kept bits of one of them.

    Every bit gets a non-zero vector of ``radius + 1`` dimensions over GF(2), dealt in
    turn so that all masks keep about as many bits.  A mask keeps a bit if the bit's
    vector has an odd product with the mask's.  At most ``radius`` differing bits
    have as many vectors, which leave a non-zero vector orthogonal to all of them.
    """
    vectors = [1 + bit % (2 ** (radius + 1) - 1) for bit in range(bits)]
    return [sum(1 << bit for bit in range(bits) if (v & vectors[bit]).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def points(fp: int, free: int, reach: int) -> list[tuple[int, int]]:
    """(point, changes): ``fp`` with up to ``reach`` of the bits of ``free`` changed."""
    at = [1 << k for k in range(BITS) if free >> k & 1]
    return [(fp ^ sum(c), k) for k in range(reach + 1) for c in combinations(at, k)]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``; connects exactly those joined by steps of at most ``radius`` bits."""
    near, far = radius // 2, radius - radius // 2
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept"),
                                          F.lit(_signed(~m & 2**64 - 1)).alias("free")) for k, m in enumerate(masks)]))
    buckets = classes.select("fp", tables.alias("t")).select("fp", "t.*")
    shared = buckets.groupBy("table", "kept").agg(F.count("*").alias("size")).filter("size > 1").select("table", "kept")
    # the bits that are free in any table where the fingerprint meets another one
    meets = staged(buckets.join(shared, ["table", "kept"]).groupBy("fp").agg(F.bit_or("free").alias("free")), "meets")

    if far == 1:  # the fingerprint and its one-bit changes, as columns
        changes = F.filter(F.array(*[F.lit(_signed(1 << k)) for k in range(BITS)]), lambda x: x.bitwiseAND(F.col("free")) != 0)
        at = meets.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), changes)).alias("change"))
        at = at.select(F.col("fp").bitwiseXOR(F.col("change")).alias("point"), "fp",
                       (F.lit(near == 1) | (F.col("change") == 0)).alias("near"))
    else:
        def spread_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for fp, free in zip(batch["fp"], batch["free"]):
                    found = points(fp % 2**64, free % 2**64, far)
                    yield pd.DataFrame({"point": np.array([p for p, _ in found], np.uint64).view(np.int64),
                                        "fp": fp, "near": [k <= near for _, k in found]})

        at = meets.mapInPandas(spread_out, "point long, fp long, near boolean")
    # at most 1 + 64 (radius 2) fingerprints lie as near to a point: the lists are bounded
    met = at.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all"))
    return (met.filter("size(all) > 1 and a is not null").select("a", F.explode("all").alias("b"))
            .filter("a <> b").distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                       width: int = WIDTH) -> DataFrame:
    """(id, fp, component) of each row of ``docs``."""
    if radius < 1:
        raise ValueError("radius must be at least 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = staged(fingerprints(rows, width), "fingerprints")
    classes = staged(every.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    # rows of one id with different fingerprints
    ids = every.filter("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z")
    same = every.join(ids, "id").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    found = components(staged(links(classes, radius).unionByName(same), "links"))
    labelled = classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component"))
    label = staged(labelled.join(least, "label").select("fp", "component"), "labels")
    return every.join(label, "fp").select("id", "fp", "component")


def op11_simhash(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs.select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
