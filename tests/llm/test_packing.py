import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelcast.llm import packing as P


def check_places(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(documents):
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    rows = P.op3_packing(documents).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.piece] = r
    for d in documents.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        cut = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(got[d.doc_id]) == list(range(len(cut)))
        for k, part in enumerate(cut):
            r = got[d.doc_id][k]
            assert (r.start, r.length, r.ids_crc32) == (4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    used = check_places(rows)
    assert used <= math.ceil(sum(r.length for r in rows) / 4096) * 1.05 + 1


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plan_holds_every_piece_once(n):
    rng = np.random.default_rng(n)
    length = np.clip(rng.lognormal(6.5, 1.0, n).astype(int), 1, 4096)
    counts = {int(k): int(v) for k, v in Counter(length.tolist()).items()}
    runs = P.plan(counts)
    held = Counter()
    for m, content in runs:
        assert m > 0 and sum(s * k for s, k in content) <= 4096
        for s, k in content:
            held[s] += m * k
    assert held == Counter(counts)
    assert sum(m for m, _ in runs) <= math.ceil(length.sum() / 4096) * 1.02 + 2


def test_plan_of_equal_large_pieces():
    assert sum(m for m, _ in P.plan({1365: 3000})) == 1000
    assert sum(m for m, _ in P.plan({2049: 50})) == 50
    assert sum(m for m, _ in P.plan({4096: 10, 3000: 10, 1096: 10})) == 20


def test_words_by_bulk_are_the_whole_texts_ids():
    texts = ["A.B. a.,b .. x... it's. 12.5, 3. 'S. don't, l'T.", "a\x1cb c\xa0d.", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", None, "",
             " ", "ΟΔΟΣ Σ σ.", "e ́ x.", "日本語, x.", "\n\na.\n", "É. é, Ö."]
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    ids, first = P.encoded(P.tokenizer_path(), pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_odd_rows_and_hot_lengths(spark, odd, empty):
    rows = P.pack(odd.select("doc_id", "text"), rows_per_slice=2, with_ids=True).collect()
    check_places(rows)
    assert sum(r.doc_id == 9 for r in rows) == 2 * sum(r.doc_id == 8 for r in rows) > 2
    assert all(len(r.ids) == r.length for r in rows)
    assert [(r.piece, r.length) for r in rows if r.doc_id == 5] == [(0, 1)]
    assert P.op3_packing(empty).collect() == []
    same = spark.range(500).selectExpr("id as doc_id", "repeat('same words ', 300) as text")
    assert check_places(P.pack(same, rows_per_slice=7).collect()) == math.ceil(500 / (4096 // 601))


def test_frequent_words_stay_known(monkeypatch):
    """Rare words push each other out, not the words of every text; ids stay those of the whole text."""
    from types import SimpleNamespace

    import pyarrow as pa
    import tokenizers

    from panelcast.llm import packing

    path = packing.tokenizer_path()
    real, coded = tokenizers.Tokenizer.from_file(path), []

    def encode(text, add_special_tokens):
        coded.extend(text.split(" "))
        return real.encode(text, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(packing, "_CACHES", {})
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    monkeypatch.setattr(tokenizers, "Tokenizer", SimpleNamespace(from_file=lambda _: SimpleNamespace(encode=encode)))
    for k in range(20):
        texts = ["the sea " + " ".join(f"rare{k}x{j}" for j in range(30)) + " " + "long" * 20, f"The sea, {k}."]
        ids, first = packing.encoded(path, pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [
            real.encode(t, add_special_tokens=False).ids for t in texts]
    assert coded.count("the") == coded.count("sea") == 1
