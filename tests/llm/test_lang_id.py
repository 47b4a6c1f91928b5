import zlib

import numpy as np
import pytest

from panelcast.llm import lang_id as L
from panelcast.llm import subwords as S


def test_documents(documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = L.op5_lang_id(documents).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert L.lang_id_stage(documents).count() >= 0.99 * len(lang)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(documents):
    from pyspark.sql import functions as F

    x = documents.withColumns({"lang": F.when(S.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")),
                               "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    assert sorted(L.op5_lang_id(x).collect()) == sorted(L.op5_lang_id(documents).collect())


def test_odd_rows(odd, empty):
    rows = L.op5_lang_id(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (5, 6, 7, 10)} == {("und", 0.0)}
    assert all(r.lang_pred in ("en", "fr", "und") for r in rows)
    assert L.op5_lang_id(empty).collect() == []
    stage = L.lang_id_stage(odd)
    assert stage.columns == odd.columns and stage.filter("doc_id in (5, 6, 7, 10)").count() == 0


def test_nothing_to_learn(odd):
    from pyspark.sql import functions as F

    rows = L.op5_lang_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_gradients():
    """A step along the gradient lowers the loss of its batch."""
    rng = np.random.default_rng(1)
    bags = [(rng.integers(0, S.BUCKETS, 30), np.full(30, 1 / 30)) for _ in range(16)]
    label = rng.integers(0, 3, 16)
    model = S.SubwordSoftmax(3)
    loss = lambda: -np.log(S.softmax(np.array([model.e[b].T @ s for b, s in bags]) @ model.w + model.b)[np.arange(16), label]).mean()
    first = loss()
    for _ in range(30):
        model.step(bags, label, 0.1)
    assert loss() < 0.2 * first


def test_subwords():
    assert S.codes("Ab, ²c!").tolist() == [0, 97, 98, 0, 99, 0]
    assert len(S.codes("12 ²")) == len(S.codes(None)) == len(S.codes("")) == 0
    bucket, word = S.grams(S.codes("ab cd"), 2, 2)
    assert word.tolist() == [0, 0, 0, 1, 1, 1]
    same, _ = S.grams(S.codes("xx cd"), 2, 2)
    assert bucket.tolist()[3:] == same.tolist()[3:] and bucket.tolist()[:3] != same.tolist()[:3]
    assert len(S.grams(S.codes("a"), 3, 5)[0]) == 1


@pytest.mark.parametrize("text", ["x" * 300_000, "word " * 60_000])
def test_very_long(spark, text):
    df = spark.createDataFrame([(k, text, "en") for k in range(4)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.op5_lang_id(df).collect()} == {"en"}


def test_a_rare_language_is_learned(spark):
    """Far rarer than one in ``sample_rows``, and still known on its held-out documents."""
    rng = np.random.default_rng(6)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    text = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(20))
    rows = [(k, "cc" if k % 300 == 5 else "aa" if k % 3 else "bb") for k in range(9000)]
    df = spark.createDataFrame([(k, text(y), y) for k, y in rows], "doc_id long, text string, lang string")
    ids = L.sample_of_languages(df, 120).collect()
    assert [sum(r.lang == y for r in ids) for y in ("aa", "bb", "cc")] == [45, 45, 30]
    model = L.fit(df, sample_rows=120)
    assert model.langs == ["aa", "bb", "cc"]
    out = L.with_language(df.filter("lang = 'cc'"), model).filter(S.held_out(df["doc_id"])).collect()
    assert out and all(r.lang_pred == "cc" and not r.rejected for r in out)


@pytest.mark.parametrize("counts, level", [([], 1), ([5], 5), ([5, 5], 5), ([3, 100, 100], 28), ([50, 100, 100], 20), ([1] * 90, 1)])
def test_water_level(counts, level):
    assert L.water_level(counts, 60) == level
    assert sum(min(n, level) for n in counts) <= max(60, len(counts))


def test_rows_that_share_an_id_leave_room_for_every_language(spark, documents):
    """One `it` id, 3,000 times, counts as one document of the sample."""
    from pyspark.sql import functions as F

    rows = documents.select("doc_id", "text", "lang")
    own = next(k for k in range(10**6, 10**6 + 9) if zlib.crc32(str(k).encode()) % 3 != 1)  # may be learned from
    hot = spark.range(3000).select(F.lit(own).cast("long").alias("doc_id"), F.lit("una frase sola ripetuta qui").alias("text"), F.lit("it").alias("lang"))
    model = L.fit(rows.unionByName(hot), sample_rows=150)
    known = {r.lang for r in rows.select("lang").distinct().collect() if r.lang}
    assert set(model.langs) == known | {"it"}
    out = L.with_language(rows, model).filter(S.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def plain_prediction(model, text):
    """Language and score of a text by loops over its n-grams."""
    letters, c = [], []
    for ch in f" {(text or '').lower()} ":
        c.append(ord(ch) if ch.isalpha() else 0)
    for k in c:
        if k or (letters and letters[-1]) or not letters:
            letters.append(k)
    if not any(letters):
        return "und", 0.0
    rows = []
    for n in range(L.LOW, L.HIGH + 1):
        for k in range(len(letters) - n + 1):
            g = letters[k:k + n]
            if 0 in (g if n == 1 else g[1:-1]):
                continue
            h = g[0] + 1
            for x in g[1:]:
                h = (h * 0x100000001B3 + x) % 2**64
            rows.append(model.table[((h ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - S.BITS)])
    z = (np.mean(rows, axis=0, dtype=np.float64) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_every_document_against_loops(documents, odd):
    model = L.fit(documents)
    for df in (documents, odd):
        for r in L.with_language(df.select("doc_id", "text"), model).collect():
            lang, score = plain_prediction(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)
