"""Spelling variant grouping by reduced-alphabet generation.

1. Words are counted over whole texts with built-in functions; counts are
   combined before the shuffle, so a frequent word is never one task's work.
2. Every letter is hashed to one of ``SYMBOLS`` symbols, and words with the same
   reduced form are one group.
3. The full one-edit neighbourhood of each reduced word is joined to the reduced
   vocabulary.  Of two reduced words one edit apart, one is the other with a
   symbol replaced, or the shorter is the longer with a symbol deleted; so
   replacements are generated towards the larger key, and insertions by the
   longer word as deletions: each pair of the neighbourhood comes up once.  Keys
   are 64-bit polynomial hashes, of which every edit is a constant number of
   operations, so very long words cost their length and not its square.
4. The words of two neighbouring groups (and of one group among themselves) are
   verified on the original strings.  Colliding keys only add candidates.
5. Where a group holds more than ``GROUP`` words, its words are not crossed with
   those of its neighbours: they are keyed by their own one-letter deletions,
   which near words share, so that candidates stay bounded by the alphabet.
6. A word's form is the most frequent near word that is ten times as frequent;
   roots follow forms by pointer doubling (counts grow tenfold each step, so
   five rounds cover any chain of 64-bit counts).

Defined results: null and empty texts have no words; a null id counts as the
empty string in the hash; rows that share an id count each (all of them are
occurrences); words of equal count are ordered by code points; an empty table
gives an empty result.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: What stands between words; of the letters only A-Z are lower-cased.
NOT_RUN = "[^A-Za-zÀ-ÿ]+"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, SLIP = 7, 2, 10, 31
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Groups of reduced words beyond this size are joined by deletions instead.
GROUP = 64
B = 0x9E3779B97F4A7C15 | 1
M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def symbol_of(letter: str, symbols: int) -> str:
    """The symbol that stands for a letter: its hash, as one of the first ``symbols`` letters."""
    return chr(ord("a") + ((ord(letter) * 0x9E3779B1 & 0xFFFFFFFF) >> 15) % symbols)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, LETTERS, "".join(symbol_of(x, symbols) for x in LETTERS))


# -- keys -----------------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, B, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Words:
    """Code points of a batch of non-empty words, with the sums that their keys are made of."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(self.codes)) - self.start[self.owner]
        self.power = _powers(int(self.size.max()) if len(words) else 0)
        self.term = self.codes * self.power[self.at]
        upto = np.cumsum(self.term, dtype=np.uint64)
        before = (upto - self.term)[self.start] if len(words) else upto
        self.before = upto - self.term - before[self.owner]  # sum of the terms left of each position
        self.total = (upto[self.start + self.size - 1] - before) if len(words) else upto

    def keys(self) -> np.ndarray:
        return self._key(self.total, self.size)

    @staticmethod
    def _key(total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mix(total + size.astype(np.uint64) * M3)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(word number, key) of the distinct results of deleting one letter: one for each run of equal letters."""
        first = (self.at == 0) | (self.codes != np.r_[np.uint64(0), self.codes[:-1]]) if len(self.codes) else self.at == 0
        after = self.total[self.owner] - self.before - self.term
        left = self.before + after * np.uint64(pow(B, -1, 2**64))
        return self.owner[first], self._key(left, self.size[self.owner] - 1)[first]

    def replacements(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, key) of the results of replacing one letter by another of ``letters``."""
        owner, key = [], []
        for x in letters.astype(np.uint64):
            other = np.flatnonzero(self.codes != x)
            of = self.owner[other]
            total = self.total[of] + (x - self.codes[other]) * self.power[self.at[other]]
            owner.append(of)
            key.append(self._key(total, self.size[of]))
        return np.concatenate(owner), np.concatenate(key)


#: Letters handled at once; a longer word is a batch of its own.
LETTERS_AT_ONCE = 200_000


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        size = np.cumsum([len(w) for w in batch.column(column).to_pylist()])
        cut = 0
        while cut < batch.num_rows:
            base = size[cut - 1] if cut else 0
            end = max(int(np.searchsorted(size, base + LETTERS_AT_ONCE, "right")), cut + 1)
            part = batch.slice(cut, end - cut)
            yield part, Words(part.column(column).to_pylist())
            cut = end


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def with_key(words: DataFrame, column: str) -> DataFrame:
    """``words`` and the 64-bit ``key`` of a column of words."""
    at = words.columns.index(column)
    names = [*words.columns, "key"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _batches(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, _long(w.keys())], names=names)

    return words.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", key long")


def neighbourhoods(groups: DataFrame, symbols: int) -> DataFrame:
    """(key, near): of each reduced word its deletions, and its replacements of a larger key."""
    letters = np.arange(ord("a"), ord("a") + symbols)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _batches(batches, 0):
            own = w.keys()
            of, near = w.deletions()
            also, there = w.replacements(letters)
            up = there.view(np.int64) > own[also].view(np.int64)
            yield pa.RecordBatch.from_arrays([_long(np.r_[own[of], own[also[up]]]), _long(np.r_[near, there[up]])],
                                             names=["key", "near"])

    return groups.select("reduced").mapInArrow(edits, "key long, near long")


def deletion_keys(words: DataFrame) -> DataFrame:
    """(of, key): the key of each word, and with it that key and those of its one-letter deletions."""
    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _batches(batches, 0):
            own = w.keys()
            of, near = w.deletions()
            yield pa.RecordBatch.from_arrays([_long(np.r_[own, own[of]]), _long(np.r_[own, near])], names=["of", "key"])

    return words.select("word").mapInArrow(edits, "of long, key long")


# -- vocabulary and near words ----------------------------------------------------------
def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least seven letters found at least twice, after the slips."""
    run = F.explode(F.split(ascii_lower(F.col("text")), NOT_RUN)).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"), run)
    runs = runs.filter(F.char_length("run") >= LEAST_LENGTH).withColumn(
        "h", F.crc32(F.concat("of", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """(a, b), each pair of words exactly one inserted, deleted or replaced code point apart once.

    ``words`` holds distinct non-empty words (``word``) of ``LETTERS``.
    """
    keyed = staged(with_key(words.select("word", reduced(F.col("word"), symbols).alias("reduced")), "reduced"), "keyed")
    groups = staged(keyed.groupBy("key", "reduced").agg(F.count("*").alias("size")).select("reduced", "key", "size"), "groups")
    sizes = groups.groupBy("key").agg(F.sum("size").alias("size"))
    found = neighbourhoods(groups, symbols).join(sizes.select(F.col("key").alias("near"), F.col("size").alias("near_size")), "near")
    found = found.select("key", "near", "near_size").distinct().join(sizes, "key")
    found = found.unionByName(sizes.filter("size > 1").select("key", F.col("key").alias("near"), "size", F.col("size").alias("near_size")))
    found = staged(found, "pairs")

    few = found.filter(F.greatest("size", "near_size") <= group).select("key", "near")
    few = few.join(keyed.select("key", F.col("word").alias("a")), "key")
    few = few.join(keyed.select(F.col("key").alias("near"), F.col("word").alias("b")), "near")
    few = few.filter((F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))).select("a", "b")

    # words of large groups, and of the groups next to them
    many = found.filter(F.greatest("size", "near_size") > group)
    of = many.select("key").unionByName(many.select(F.col("near").alias("key"))).distinct()
    large = staged(with_key(keyed.join(of, "key", "left_semi").select("word"), "word"), "large")
    edits = staged(deletion_keys(large), "edits")
    shared = edits.select("key", F.col("of").alias("x")).join(edits.select("key", F.col("of").alias("y")), "key")
    shared = shared.filter("x <= y").select("x", "y").distinct()
    shared = shared.join(large.select(F.col("key").alias("x"), F.col("word").alias("a")), "x")
    shared = shared.join(large.select(F.col("key").alias("y"), F.col("word").alias("b")), "y").filter("a <> b").select("a", "b")

    pairs = few.unionByName(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words and their forms (``word``, ``form``); chains without a loop."""
    cur = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = staged(cur.join(on, "root", "left").select("word", "root", "further"), "roots")
        cur = nxt.select("word", F.coalesce("further", "root").alias("root"))
        if nxt.filter("further is not null").isEmpty():
            return cur


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``doc_id``, ``text``."""
    words = staged(vocabulary(docs), "words")
    pairs = staged(near_pairs(words, symbols, group), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("neg"), "b")).alias("best"))
    out = words.join(best, words["word"] == best["a"], "left")
    fits = F.when(-F.col("best.neg") >= FORM_RATIO * F.col("n"), F.col("best"))
    out = staged(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            fits.getField("b").alias("form"), (-fits.getField("neg")).alias("form_n")), "forms")
    root = roots(out.filter("form is not null"))
    return out.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(docs: DataFrame) -> DataFrame:
    out = spelling_variants(docs.select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 bit by bit: each byte is taken in, then eight steps (256) follow.
SQL = r"""
WITH RECURSIVE
doc AS (SELECT coalesce(doc_id::VARCHAR, '') AS did,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents),
run AS (SELECT did, unnest(regexp_extract_all(t, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM doc),
cnt AS (SELECT did, run, count(*) AS k FROM run WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(did || ':' || run)) AS x FROM cnt),
steps AS (SELECT run, k, flatten([[0::UBIGINT]] || list_transform(range(length(x) // 2), lambda i: [
            (16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1)
             + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)::UBIGINT,
            256::UBIGINT, 256, 256, 256, 256, 256, 256, 256])) AS s FROM hexed),
hashed AS (SELECT run, k, xor(list_reduce(s, lambda c, b: CASE WHEN b < 256 THEN xor(c, b)
                          ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END, 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM steps),
slip AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                ELSE run END AS word, k FROM hashed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM slip WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM places),
near AS (SELECT a.word AS a, b.word AS b, b.n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM del a JOIN vocab b ON a.d = b.word
         UNION SELECT b.word, a.word, a.n FROM del a JOIN vocab b ON a.d = b.word),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near,
                  row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near),
formed AS (SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
                  CASE WHEN r.n >= 10 * v.n THEN r.b END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n
           FROM vocab v LEFT JOIN ranked r ON v.word = r.a AND r.r = 1),
chain(word, root) AS (SELECT word, word FROM formed
                      UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ended AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN ended l ON f.word = l.word
"""
