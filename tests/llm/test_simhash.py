"""SimHash: fingerprints, the covering property, components against brute force, odd tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from panelcast.llm import simhash
from panelcast.llm.near_dedup import components
from panelcast.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[k:k + width]) for k in range(max(len(words) - width + 1, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    """[(id, fp, least id reachable)] by looking at all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = np.array([f for _, f in rows], np.uint64)
    for i, (doc, _) in enumerate(rows):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            parent[find(int(j))] = find(i)
        for j, (other, _) in enumerate(rows):
            if doc is not None and other == doc:
                parent[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, f, least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


def test_query_against_brute_force(spark, documents):
    got = QUERIES["op11_simhash"](spark, SF001)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got.collect()), key=str) == plain_components(rows)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.collect())


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd.select("doc_id", "text").collect()]
    got = simhash.simhash_components(odd).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=str) == plain_components(rows)
    assert simhash.op11_simhash(empty).collect() == []
    nobody = spark.createDataFrame([(None, "only text without an id"), (None, None)], "doc_id long, text string")
    assert {r.component_id for r in simhash.op11_simhash(nobody).collect()} == {None}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    some = combinations(range(64), radius) if radius < 3 else (random.Random(3).sample(range(64), 3) for _ in range(3000))
    assert all(any(sum(1 << b for b in bits) & m == 0 for m in masks) for bits in some)
    # every mask keeps a good half of the bits, so buckets stay small
    assert all(30 <= m.bit_count() <= 45 for m in masks)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_of_chosen_fingerprints(spark, radius):
    rnd = random.Random(radius)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):  # chains whose steps are at, under and just over the radius
        for step in range(3):
            f ^= sum(1 << b for b in rnd.sample(range(64), radius + rnd.choice([-1, 0, 0, 1])))
            fps.add(f)
    fps |= {0, 1, 2**63, 2**64 - 1, 2**64 - 1 - 2**63}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.links(df, radius)
    label = {r.node % 2**64: r.component for r in components(found).collect()}
    got = {}
    for f in fps:
        got.setdefault(label.get(f, simhash._signed(f)), set()).add(f)
    want = {}
    for i, _, c in plain_components(list(enumerate(fps)), radius):
        want.setdefault(c, set()).add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if radius % 2 == 0:  # a link is a pair within the radius
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= radius for r in found.collect())


def test_links_grow_with_the_family(spark):
    """Every fingerprint within two bits of one: at most 65 links (the points of one) each, not all pairs."""
    family = [0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))]
    df = spark.createDataFrame([(simhash._signed(f),) for f in family], "fp long")
    assert simhash.links(df).count() <= 65 * len(family)
