"""Best-fit packing by the linear grouping scheme.

1. Every document is tokenised once (Arrow batches, one bounded word cache per
   Python worker) and cut into pieces of at most ``capacity`` tokens; the
   pieces, a few numbers each, are staged.
2. The plan needs only the number of pieces of each length, a table of at most
   ``capacity`` rows however many documents there are.  Large lengths are split
   into ``groups`` groups of equal cardinality and rounded up to the largest of
   their group; the configurations of these few sizes are optimised by column
   generation (linear program over configurations, knapsack pricing); actual
   lengths take the rounded places; what the rounding of the program leaves over
   and all small lengths are placed best-fit, longest first.  Sequences with the
   same lengths in the same order are one run with a multiplicity, so the plan
   stays a few thousand rows.
3. Pieces of one length are interchangeable: the r-th piece of a length takes
   the r-th place of that length.  Ranks are dealt per (length, slice) with at
   most about ``rows_per_slice`` rows a slice, so a third of all rows being
   copies of one document never meets in one task.

Defined results: a null text is empty and yields one piece with the end id
alone; rows that share an id are packed each on their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, staged

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker keeps, about 30 MB as Arrow and numpy arrays.
CACHED_WORDS = 600_000
CACHED_CHARS = 48
_CACHES: dict[str, tuple] = {}


class _Words:
    """Known words and their ids; the words least recently asked for go first."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.first, self.size, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.calls = 0

    def add(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
        self.words, self.ids = pa.concat_arrays([self.words, words]), np.r_[self.ids, ids]
        self.size, self.used = np.r_[self.size, size], np.r_[self.used, np.full(len(size), self.calls)]

    def shrink(self, n: int, most: int) -> None:
        """Keep the first ``n`` words, or if those are more than ``most`` half as many, the last used ones."""
        if n == len(self.words) and n <= most:
            return
        keep = np.arange(n)
        if n > most:
            keep = np.sort(np.argsort(-self.used[:n], kind="stable")[:most // 2])
        size = self.size[keep]
        first = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.first[keep] - first, size) + np.arange(size.sum())]
        self.words, self.first, self.size, self.used = self.words.take(pa.array(keep)), first, size, self.used[keep]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- pieces ---------------------------------------------------------------------
def _tokens(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in a row, and where each word's begin and how many they are; each new word is encoded once."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHES[path] = (Tokenizer.from_file(path), _Words())
    tokenizer, known = _CACHES[path]
    known.calls += 1
    at = pc.fill_null(pc.index_in(words, value_set=known.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.flatnonzero(at < 0)
    # words too long to be kept come last
    long = pc.greater(pc.binary_length(words), CACHED_CHARS).to_numpy(zero_copy_only=False)[new]
    new = new[np.argsort(long, kind="stable")]
    kept = len(known.words) + len(new) - int(long.sum())
    if len(new):
        fresh = words.take(pa.array(new))
        ids, sizes = [], []
        for k in range(0, len(new), 2000):  # encoded in one string, cut where the words end
            part = fresh.slice(k, 2000).to_pylist()
            coded = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(coded.ids, "<u4"))
            begin = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            sizes.append(np.diff(np.searchsorted(begin, np.cumsum([len(w) + 1 for w in part])), prepend=0))
        at[new] = len(known.words) + np.arange(len(new))
        known.add(fresh, np.concatenate(ids), np.concatenate(sizes))
    known.used[at] = known.calls
    found = known.ids, known.first[at], known.size[at]
    known.shrink(kept, CACHED_WORDS)
    return found


def encoded(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, and where each text's begin (and the end).

    The tokenizer drops white space, lower-cases, never joins across white
    space and always parts a letter or digit from a full stop or comma, so
    lower-casing and a space before such a mark change no id; the distinct
    words are then few.  Special tokens are matched before lower-casing, so a
    text with their opening is left as it is.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z0-9])([.,])(\s|$)", r"\1 \2\3"))
    words = lists.flatten().dictionary_encode()
    flat, first, size = _tokens(path, words.dictionary.cast(pa.string()))
    word = words.indices.to_numpy(zero_copy_only=False)
    first, size = first[word], size[word]
    end = np.r_[0, np.cumsum(size)]
    ids = flat[np.repeat(first - end[:-1], size) + np.arange(end[-1])]
    offsets = lists.offsets.to_numpy()
    return ids, end[offsets - offsets[0]]


def _slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _slices(whole)):
            rows: list[tuple] = []
            every, first = encoded(path, batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                ids = np.concatenate([every[a:b], end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())) + ((part.astype("<i4"),) if with_ids else ()))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kinds)


# -- plan -----------------------------------------------------------------------
def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of the sizes that fits into the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        at = c - sizes
        got = np.where(at >= 0, best[np.maximum(at, 0)] + values, -1.0)
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], k
        else:
            best[c], last[c] = best[c - 1], -1
    pattern, c = np.zeros(len(sizes)), capacity
    while c >= low:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400):
    """Configurations (columns) and how often to use each (whole numbers, rounded down)
    of the linear program min sum(x), A x = demand, by column generation."""
    basis = np.diag(np.floor(capacity / sizes))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        value, column = _knapsack(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        x = np.maximum(inverse @ demand, 0)
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(len(x), np.inf)
        ratio[up] = x[up] / step[up]
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis.astype(int), np.floor(x + 1e-7).astype(np.int64)


def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, split into groups of equal cardinality."""
    if len(lengths) <= groups:
        return [[x] for x in lengths]
    each = -(-sum(n for _, n in lengths) // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = each
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 32,
         small_share: float = 1 / 8) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (multiplicity, [(length, how many in a row), ...]) that hold every counted piece."""
    runs: list[tuple[int, list]] = []
    large = sorted(((s, n) for s, n in counts.items() if n and small_share * capacity < s < capacity), reverse=True)
    rest = {s: n for s, n in counts.items() if n and s <= small_share * capacity}
    if counts.get(capacity):
        runs.append((counts[capacity], [(capacity, 1)]))
    open_runs: list[tuple[int, int, list]] = []  # multiplicity, room, content
    if large:
        grouped = linear_groups(large, groups)
        sizes = np.array([g[0][0] for g in grouped])
        demand = np.array([sum(n for _, n in g) for g in grouped], float)
        # groups that are rounded up to the same length are one size
        same, where = np.unique(sizes, return_inverse=True)
        merged = [sorted((x for g, w in zip(grouped, where) if w == k for x in g), reverse=True) for k in range(len(same))]
        a, times = configurations(same, np.bincount(where, demand), capacity)
        supply = [[list(x) for x in g] for g in merged]
        for c in range(a.shape[1]):
            n = int(times[c])
            slots = [g for g in range(len(same)) for _ in range(a[g, c])]
            while n and slots:
                for g in slots:
                    while supply[g] and not supply[g][0][1]:
                        supply[g].pop(0)
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                if any(not supply[g] for g in need):
                    break
                # sequences of one configuration with the same actual lengths are one run
                m = min([n, *(supply[g][0][1] // k for g, k in need.items())])
                content: list[tuple[int, int]] = []
                if m:
                    for g, k in need.items():
                        supply[g][0][1] -= k * m
                        content.append((supply[g][0][0], k))
                else:  # a length ends within a sequence
                    m = 1
                    for g, k in need.items():
                        while k and supply[g]:
                            take = min(k, supply[g][0][1])
                            if take:
                                content.append((supply[g][0][0], take))
                            supply[g][0][1] -= take
                            k -= take
                            if not supply[g][0][1]:
                                supply[g].pop(0)
                n -= m
                open_runs.append((m, capacity - sum(s * k for s, k in content), content))
        for g in supply:
            for s, n in g:
                rest[s] = rest.get(s, 0) + n
    # best fit: the least room that holds the piece, longest pieces first
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, list]]] = {}

    def put(m: int, room: int, content: list) -> None:
        if m:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((m, content))

    for m, room, content in open_runs:
        put(m, room, content)
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                m, content = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, content = capacity, []
                m = n
            k = room // s
            full = min(m, n // k)
            put(full, room - k * s, [*content, (s, k)])
            n, m = n - full * k, m - full
            if m and n and n < k:
                put(1, room - n * s, [*content, (s, n)])
                n, m = 0, m - 1
            if content:
                put(m, room, content)
    return runs + [(m, content) for room in rooms for m, content in by_room[room]]


# -- places -----------------------------------------------------------------------
def _places(runs: list) -> dict[str, np.ndarray]:
    """One row per (run, length): the ranks of that length it holds and where they go."""
    rows, used, sequence = [], {}, 0
    for m, content in runs:
        offset = 0
        for s, k in content:
            rows.append((s, used.get(s, 0), sequence, k, offset))
            used[s] = used.get(s, 0) + k * m
            offset += s * k
        sequence += m
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = 32,
         small_share: float = 1 / 8, rows_per_slice: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces")
    # at most `capacity` rows: one per length
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = spark.createDataFrame(
        [(s, -(-n // rows_per_slice)) for s, n in counts.items()], "length long, slices long")
    sliced = cut.join(F.broadcast(slices), "length").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("slices"))).drop("slices")
    # about one row per length and `rows_per_slice` pieces
    held = sorted((r["length"], r["slice"], r["n"]) for r in
                  sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).collect())
    first, seen = [], {}
    for s, k, n in held:
        first.append((s, k, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    shared = spark.sparkContext.broadcast((np.array(first, np.int64).reshape(-1, 3),
                                           _places(plan(counts, capacity, groups, small_share))))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("rn", F.row_number().over(order).cast("long"))
    kept = [c for c in cut.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places = shared.value
        wide = np.int64(1) << 40
        slice_key, place_key = first[:, 0] * wide + first[:, 1], places["length"] * wide + places["rank"]
        for batch in batches:
            length, part, rn = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "slice", "rn"))
            rank = rn - 1 + first[np.searchsorted(slice_key, length * wide + part), 2]
            at = np.searchsorted(place_key, length * wide + rank, side="right") - 1
            nth = rank - places["rank"][at]
            each = places["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(places["sequence"][at] + nth // each),
                 pa.array(places["offset"][at] + nth % each * length)], names=[*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op3_packing(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
