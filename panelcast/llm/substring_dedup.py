"""Repeated strings of ``SPAN`` bytes, by distributed prefix doubling.

The table is cut into slices of about ``slice_bytes``, one row each, written once in
buckets; a slice keeps its texts in one array, and every round works on whole slices.
In each round a slice sends the distinct ranks of its live positions, dealt by value
over the slices of the names; Spark brings equal ones together, a task sorts them, and
what it found goes back to the slice that asked.  A string that a third of all rows
share is therefore one number per slice of the table, never a row per position.

Whole copies of a text but the one of the least id are cut beforehand.

1. Round of 24 bytes, for pruning.  In each stretch of ``SPAN`` bytes the position whose
   24-byte name is least stands for the stretch: equal stretches choose alike, so a
   stretch can only repeat if that name does.  All positions of other stretches drop
   out before anything is sent for them.
2. Round of 48 bytes.  The pair of the 24-byte names at a position and 24 bytes on is
   sorted; a pair found in one document drops its positions out, the others get its
   place in the order as their new rank.
3. Round of 50 bytes.  The pair of the ranks that round two gave to a position and to
   the one 2 bytes on is sorted; a position whose partner dropped out does so too.  The
   least id of each pair comes back: positions of larger ids begin a repeat.
4. Covered bytes are cut from each text.

Rounds two and three run for ``ranges`` ranges of first-round names in turn, and their
shuffles and answers are released before the next range, so that the disk in use is
bounded by one range whatever share of the corpus repeats.

Names and ranks of strings over 24 bytes are 64-bit hashes of pairs: two different
strings that meet in a round agree with a probability of 2**-64 per pair.

Defined results: a null text is empty; a null id stands below every other id;
rows that share an id are one document for the comparison (none repeats the
other) and are cut each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, release, shared_path, shuffles_released, staged

SPAN, GRAM = 50, 24
REST = SPAN - 2 * GRAM
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
#: Positions named at once: what fits into a core's cache.
AT_ONCE = 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros after the end)."""
    padded = np.concatenate([b, np.zeros(15 + -len(b) % 8, np.uint8)])
    out = np.empty(len(b) + 8, np.uint64)
    for k in range(8):
        part = padded[k:k + (len(padded) - k) // 8 * 8].view(np.uint64)
        out[k::8] = part[:len(out[k::8])]
    return out[:len(b)]


def names(b: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of the n-byte strings at each position."""
    words, size = _words(b), max(len(b) - n + 1, 0)
    out, spare = np.empty(size, np.uint64), np.empty(AT_ONCE, np.uint64)
    for low in range(0, size, AT_ONCE):
        name = out[low:low + AT_ONCE]
        high = spare[:len(name)]
        name[:] = n
        for k in range(0, n, 8):  # eight more bytes: added, and their bits spread over all others
            part = words[low + k:low + k + len(name)]
            name += part if n - k >= 8 else part & np.uint64(2 ** (8 * (n - k)) - 1)
            name *= MIX
            np.right_shift(name, np.uint64(32), out=high)
            name ^= high
        name *= MIX
        np.right_shift(name, np.uint64(29), out=high)
        name ^= high
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each number among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.r_[True, x[1:] != x[:-1]][:len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], place


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) * PRIME + b)


# -- slices of the table ------------------------------------------------------------------
def sliced(docs: DataFrame, slice_bytes: int, slice_rows: int) -> DataFrame:
    """(slice, ids, ends, body): texts of consecutive rows in one array, with their ids and ends."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([ends.tobytes()]),
                 pa.array([b"".join(texts)], pa.binary())], names=["slice", "ids", "ends", "body"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(ident)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= slice_bytes or len(ids) >= slice_rows:
                    yield out()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield out()

    return docs.select("id", "text").mapInArrow(gather, "slice long, ids binary, ends binary, body binary")


class Slice:
    """The texts of a slice: 24-byte names, and the runs of positions whose stretches have one least name."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.bytes = np.frombuffer(body, np.uint8)
        self.gram = names(self.bytes, GRAM) if len(self.bytes) >= SPAN else np.empty(0, np.uint64)
        starts = max(len(self.bytes) - SPAN + 1, 0)
        whole = np.ones(starts, bool)
        for low, high in zip([0, *self.ends[:-1].tolist()], self.ends.tolist()):
            whole[max(high - SPAN + 1, low):high] = False
        width, least, step = SPAN - GRAM + 1, self.gram, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
            step *= 2
        least = np.minimum(least[:starts], least[width - step:][:starts]) if starts else least[:0]
        # a stretch ends with its text, so that runs of two texts never touch
        other = least[1:] != least[:-1]
        begin, finish = whole.copy(), whole.copy()
        begin[1:] &= other | ~whole[:-1]
        finish[:-1] &= other | ~whole[1:]
        self.start = np.flatnonzero(begin)
        self.size = np.flatnonzero(finish) - self.start + 1
        self.name, self.of_run = _distinct(least[self.start])

    def of(self, p: np.ndarray) -> np.ndarray:
        """The id of the document of each position."""
        return self.ids[np.searchsorted(self.ends, p, "right")]

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct least names, and whether two documents of the slice hold them."""
        ident = self.of(self.start)
        low, high = np.full(len(self.name), 2**63 - 1), np.full(len(self.name), -2**63)
        np.minimum.at(low, self.of_run, ident)
        np.maximum.at(high, self.of_run, ident)
        return self.name, low != high

    def live(self, chosen: np.ndarray) -> np.ndarray:
        """Positions whose least name is among the chosen ones."""
        runs = chosen[self.of_run]
        start, size = self.start[runs], self.size[runs]
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _slot(name: np.ndarray, slots: int) -> np.ndarray:
    """Which slice of the names a name belongs to; by its low bits, as least names are small numbers."""
    return ((name & LOW) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _pair_slot(pair: np.ndarray, slots: int) -> np.ndarray:
    """The slice of the names of a pair; by its high bits, so that sorted pairs lie in the order of their slices."""
    return _slot(pair >> np.uint64(32), slots)


class Dealt:
    """Sorted distinct names, or pairs of them, dealt over the slices of the names."""

    def __init__(self, name: np.ndarray, slots: int, pairs: bool = False):
        self.size, self.order = len(name), None
        if pairs:
            slot = _pair_slot(name, slots)
        else:
            slot = _slot(name, slots)
            self.order = np.argsort(slot.astype(np.uint16) if slots < 65_536 else slot, kind="stable")
            slot = slot[self.order]
        begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][:len(slot)])
        self.parts = list(zip(slot[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(name)]))

    def _at(self, a: int, b: int):
        return slice(a, b) if self.order is None else self.order[a:b]

    def sent(self, of: int, name: np.ndarray, more: np.ndarray, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """A row per slice of the names: names, what goes with each, and what that refers to (whole in every row)."""
        if self.parts:
            cut = lambda c: pa.array([c[self._at(a, b)].tobytes() for _, a, b in self.parts], pa.binary())
            key = b"" if key is None else key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in self.parts], pa.int32()), pa.array([of] * len(self.parts), pa.int64()), cut(name), cut(more),
                 pa.array([key] * len(self.parts), pa.binary())], names=["slot", "slice", "name", "more", "key"])

    def answers(self, got: list[dict] | None, kind: type) -> np.ndarray:
        """What came back for each name, in their order (0 where nothing did)."""
        out, by = np.zeros(self.size, kind), {x["slot"]: x["answer"] for x in got or ()}
        for s, a, b in self.parts:
            if s in by:
                out[self._at(a, b)] = np.frombuffer(by[s], kind)
        return out


SENT = "slot int, slice long, name binary, more binary, key binary"
ANSWER = "slot int, slice long, answer binary"


def _meeting(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all slices of the table in order: the order, where each name's group begins, the group of each, row ends."""
    name = np.frombuffer(b"".join(x["name"]), np.uint64)
    order = np.argsort(name)
    first = np.r_[True, name[order][1:] != name[order][:-1]][:len(name)]
    group = np.empty(len(name), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group, np.cumsum([len(b) // 8 for b in x["name"]])


def _back(x: pd.DataFrame, answer: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    parts = np.split(answer, ends[:-1]) if len(ends) else []
    some = [k for k, p in enumerate(parts) if p.any()]
    return pd.DataFrame({"slot": x["slot"].to_numpy()[some], "slice": x["slice"].to_numpy()[some],
                         "answer": [np.ascontiguousarray(parts[k]).tobytes() for k in some]})


def _repeated(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each name, whether two slices or two documents of one hold the group, row ends."""
    order, begin, group, ends = _meeting(x)
    several = np.frombuffer(b"".join(x["more"]), bool)
    live = (np.diff(np.r_[begin, len(order)]) > 1) | (np.bincount(group[several], minlength=len(begin)) > 0)
    return group, live, ends


def _keep_repeated(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    group, live, ends = _repeated(x)
    return _back(x, live[group], ends)


def _rank(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """The place of each repeated pair among those of its slice of the names, from 1."""
    group, live, ends = _repeated(x)
    return _back(x, np.where(live, np.cumsum(live), 0).astype(np.uint32)[group], ends)


def _least_ids(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """Whether another slice of the table holds the pair under a smaller id."""
    order, begin, group, ends = _meeting(x)
    ident = [np.frombuffer(k, np.int64)[np.frombuffer(m, np.uint16)] for k, m in zip(x["key"], x["more"])]
    ident = np.concatenate(ident) if ident else np.empty(0, np.int64)
    least = np.minimum.reduceat(ident[order], begin) if len(begin) else ident[:0]
    return _back(x, least[group] < ident, ends)


# -- rounds --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Positions:
    """What the tasks of all rounds work out alike: live positions of a slice, their pairs, and the pairs of their ranks."""

    slots: int
    ranges: int

    def positions(self, s: Slice, live: list[dict] | None, at: int) -> np.ndarray:
        """Live positions of the slice whose first-round name is in range ``at``."""
        chosen = Dealt(s.name, self.slots).answers(live, bool) & (_slot(s.name, self.slots) % self.ranges == at)
        return s.live(chosen)

    def pairs(self, s: Slice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions that round two ranks (the live ones and their partners of round three), distinct pairs, pair of each,
        and how many such positions lie before each position of the slice."""
        ranked = np.zeros(len(s.gram), bool)
        for k in range(REST + 1):
            ranked[p + k] = True
        q = np.flatnonzero(ranked)
        pair, of = _distinct(_pair(s.gram[q], s.gram[q + GRAM]))
        return q, pair, of, np.cumsum(ranked) - ranked

    def ranked(self, s: Slice, p: np.ndarray, ranks: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions still live, distinct pairs of their ranks, pair of each, least id of each pair in the slice."""
        q, pair, number, before = self.pairs(s, p)
        place = Dealt(pair, self.slots, True).answers(ranks, np.uint32).astype(np.uint64)
        rank = np.where(place > 0, (_pair_slot(pair, self.slots).astype(np.uint64) << np.uint64(32)) | place, np.uint64(0))[number]
        a, b = rank[before[p]], rank[before[p + REST]]
        on = (a > 0) & (b > 0)
        p = p[on]
        name, of = _distinct(_pair(a[on], b[on]))
        least = np.full(len(name), 2**63 - 1)
        np.minimum.at(least, of, s.of(p))
        return p, name, of, least


class Rounds:
    """The slices of a table and what the rounds gave back to them."""

    def __init__(self, table: DataFrame, slots: int, ranges: int):
        self.table, self.at = table, Positions(slots, ranges)

    def exchange(self, sent: DataFrame, meet, name: str) -> DataFrame:
        return staged(sent.groupBy("slot").applyInPandas(meet, ANSWER), name)

    def with_answers(self, **answers: DataFrame) -> DataFrame:
        """Each slice with the answers it got: only these are moved and hashed, the slices stay in their buckets unsorted."""
        x = self.table
        for name, df in answers.items():
            got = df.groupBy("slice").agg(F.collect_list(F.struct("slot", "answer")).alias(name))
            x = x.join(got.hint("shuffle_hash"), "slice", "left")
        return x

    def first(self) -> DataFrame:
        slots = self.at.slots

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for of, s, _ in _slices(batches):
                name, several = s.sampled()
                yield from Dealt(name, slots).sent(of, name, several)

        return self.exchange(self.table.mapInArrow(send, SENT), _keep_repeated, "live")

    def second(self, live: DataFrame, at: int) -> DataFrame:
        own = self.at

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for of, s, (found,) in _slices(batches):
                q, pair, number, _ = own.pairs(s, own.positions(s, found, at))
                if len(pair):
                    ident = s.of(q)
                    low, high = np.full(len(pair), 2**63 - 1), np.full(len(pair), -2**63)
                    np.minimum.at(low, number, ident)
                    np.maximum.at(high, number, ident)
                    yield from Dealt(pair, own.slots, True).sent(of, pair, low != high)

        return self.exchange(self.with_answers(live=live).mapInArrow(send, SENT), _rank, "ranks")

    def third(self, live: DataFrame, ranks: DataFrame, at: int) -> DataFrame:
        own = self.at

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for of, s, (found, places) in _slices(batches):
                _, name, _, least = own.ranked(s, own.positions(s, found, at), places)
                ids = np.unique(s.ids)
                number = np.searchsorted(ids, least)
                yield from Dealt(name, own.slots, True).sent(of, name, number.astype(np.uint16), ids)

        return self.exchange(self.with_answers(live=live, ranks=ranks).mapInArrow(send, SENT), _least_ids, "earlier")

    def covered(self, live: DataFrame, ranks: DataFrame, earlier: DataFrame, at: int) -> DataFrame:
        """(slice, low, high): the runs of bytes that repeats of this range cover."""
        own = self.at

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for of, s, (found, places, early) in _slices(batches):
                p, name, number, least = own.ranked(s, own.positions(s, found, at), places)
                if len(p):
                    p = p[(s.of(p) > least[number]) | Dealt(name, own.slots, True).answers(early, bool)[number]]
                if len(p):
                    low, high = _runs(p, p + SPAN)
                    yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([low.tobytes()]), pa.array([high.tobytes()])],
                                                     names=["slice", "low", "high"])

        x = self.with_answers(live=live, ranks=ranks, earlier=earlier).mapInArrow(find, "slice long, low binary, high binary")
        return staged(x, "covered")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Slice, list]]:
    """Number, texts and answers of the slices of a batch, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            of, ids, ends, body, *more = (c[k].as_py() for c in batch.columns)
            yield of, Slice(ids, ends, body), more


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals sorted by their beginnings."""
    high = np.maximum.accumulate(high)
    new = np.r_[True, low[1:] > high[:-1]]
    return low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(low) - 1]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, n_removed, n_spans, kept) of each text of a slice with the runs found for it."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, ends, body, found = (c[k].as_py() for c in batch.columns[1:])
            ids, ends, b = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(body, np.uint8)
            gone = np.zeros(len(b) + 1, np.int64)
            for x in found or ():
                np.add.at(gone, np.frombuffer(x["low"], np.int64), 1)
                np.add.at(gone, np.frombuffer(x["high"], np.int64), -1)
            gone = np.cumsum(gone)[:-1] > 0
            starts = np.r_[0, ends[:-1]]
            # a run that ends with its text is a run of its own, whatever the next text begins with
            begins = gone & ~np.r_[False, gone[:-1]]
            begins[starts[starts < len(b)]] = gone[starts[starts < len(b)]]
            count = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
            kept = b[~gone].tobytes()
            at = np.r_[0, np.cumsum(~gone)][np.r_[0, ends]].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.diff(np.r_[0, ends])), pa.array(count(gone).astype(np.int64)), pa.array(count(begins).astype(np.int64)),
                 pa.array([kept[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


@contextmanager
def _bucketed(df: DataFrame, buckets: int):
    """``df`` written once in buckets of its slices, without a shuffle; table and files go afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, "slices")
    table = f"panelcast_{path.rpartition('-')[2]}"
    df.write.bucketBy(buckets, "slice").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        files = spark.table(table)
        release(spark, files)
        spark.sql(f"DROP TABLE {table}")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 50_000,
                     slice_bytes: int = 1 << 19, names_per_slice: int = 2_000_000, ranges: int = 2) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row; ``kept`` is what is left, as bytes.

    A null id is ``NULL_ID`` here.  A slice holds at most ``slice_rows`` (under 65,536) rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text"))
    # all strings of a whole copy are in the copy of the least id: the others are cut without being looked at
    base = base.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(SPAN), "text"), "n_bytes": F.octet_length("text").cast("long")})
    same = ["t1", "t2", "n_bytes"]
    copied = base.filter(F.col("n_bytes") >= SPAN).groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copied = staged(copied.filter("n > 1").drop("n"), "copied")
    marked = base.join(copied, same, "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    base = marked.filter(~copy).select("id", "text")
    cut = marked.filter(copy).select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                     F.lit(b"").cast("binary").alias("kept"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slots = ranges * max(1, -(-total // (8 * names_per_slice * ranges)))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // (16 * slice_bytes)), 100_000))
    with shuffles_released(spark), _bucketed(sliced(base, slice_bytes, slice_rows), buckets) as table:
        rounds = Rounds(table, slots, ranges)
        live, covered = rounds.first(), []
        for at in range(ranges):
            ranks = rounds.second(live, at)
            earlier = rounds.third(live, ranks, at)
            covered.append(rounds.covered(live, ranks, earlier, at))
            for df in (ranks, earlier):
                release(spark, df)
        release(spark, live)
        every = covered[0]
        for df in covered[1:]:
            every = every.unionByName(df)
        runs = every.groupBy("slice").agg(F.collect_list(F.struct("low", "high")).alias("found"))
        out = staged(table.join(runs.hint("shuffle_hash"), "slice", "left").mapInArrow(
            _cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(cut), "kept")
        for df in covered:
            release(spark, df)
    return out


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """The digest of distinct ids by a table of all strings of ``span`` bytes (small inputs only)."""
    least: dict[bytes, int] = {}
    for ident, b in sorted(rows):
        for k in range(len(b) - span + 1):
            least.setdefault(b[k:k + span], ident)
    out = {}
    for ident, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if least[b[k:k + span]] < ident:
                gone[k:k + span] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[ident] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out
