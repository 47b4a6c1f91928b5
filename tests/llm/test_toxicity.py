import zlib

import numpy as np
import pytest

from panelcast.llm import toxicity as T

RNG = np.random.default_rng(5)
SYLLABLES = "an ber con del eth for gan hal ist jon kel lor men nor oth per quil ran sel tor und ver win yor zan".split()


def prose(n):
    return " ".join("".join(RNG.choice(SYLLABLES, RNG.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = [], []
    for k in range(600):
        words = prose(int(RNG.integers(30, 400))).split()
        toxic = k % 4 == 0
        if toxic:
            for at in RNG.integers(0, len(words), max(2, len(words) // 40)):
                words[at] = RNG.choice(["grublokk", "snarvikk", "plotzhex", "grublokker", "vikksnarv"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out(corpus):
    docs, labels = corpus
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.op6_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.97


def test_misspelled(spark, corpus):
    model = T.fit(*corpus)
    base = prose(60)
    df = spark.createDataFrame([(1, f"{base} grublokks snarvikky grublookk {base}"), (2, f"{base} {base}")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in T.scored(df, model).collect()}
    assert score[1] > 0.7 > 0.3 > score[2]


def test_odd_rows(spark, corpus, odd, empty):
    docs, labels = corpus
    model = T.fit(docs, labels)
    score = {r.doc_id: r.score for r in T.scored(odd, model).collect()}
    assert all(0 <= s < 0.7 for s in score.values())
    assert score[5] == score[6] == score[7] == score[10]
    more = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (10**9, 1), (2, 0)], "doc_id long, toxic int"))
    assert T.op6_toxicity(docs, more.repartition(4)).count() == 600
    assert T.op6_toxicity(empty, labels).collect() == []
    assert max(r.score for r in T.op6_toxicity(docs, labels.limit(0)).collect()) < 1e-6


def test_hostility_is_the_best_window():
    x = np.array([0.0, 0, 0, 8, 0, 0, 0, 0])
    assert T.hostility(x) == 8 / T.WINDOW
    assert T.hostility(np.array([3.0])) == 3 and T.hostility(np.array([])) == 0


def test_labels_of_held_out_rows_do_not_matter(corpus):
    from pyspark.sql import functions as F
    from panelcast.llm.subwords import held_out

    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(T.op6_toxicity(docs, flipped).collect()) == sorted(T.op6_toxicity(docs, labels).collect())


def test_rows_that_share_an_id_leave_room_for_others(spark, corpus):
    """One clean id, 3,200 times, counts as one document of the sample."""
    from pyspark.sql import functions as F

    docs, labels = corpus
    hot = spark.range(3200).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same clean text").alias("text"))
    rows = T.op6_toxicity(docs.filter("doc_id <> 3").unionByName(hot), labels).filter("held_out").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    caught = [r.predicted for r in rows if truth[r.doc_id]]
    assert len(caught) > 30 and np.mean(caught) > 0.97


def plain_score(model, text):
    """Score of a text by loops over its words, their n-grams and all windows."""
    words, word = [], ""
    for ch in f"{(text or '').lower()} ":
        if ch.isalpha():
            word += ch
        elif word:
            words.append([0, *map(ord, word), 0])
            word = ""
    scores = []
    for w in words:
        got = []
        for n in range(T.LOW, T.HIGH + 1):
            for k in range(len(w) - n + 1):
                h = w[k] + 1
                for x in w[k + 1:k + n]:
                    h = (h * 0x100000001B3 + x) % 2**64
                got.append(float(model.table[((h ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.S.BITS), 0]))
        scores.append(sum(got) / len(got))
    n = min(T.WINDOW, len(scores))
    worst = max((sum(scores[k:k + n]) / n for k in range(len(scores) - n + 1)), default=0.0) if n else 0.0
    return 1 / (1 + np.exp(-np.clip(model.scale * (worst + model.bias) + model.shift, -30, 30)))


def test_every_document_against_loops(corpus, odd):
    model = T.fit(*corpus)
    for df in (corpus[0].filter("doc_id < 200"), odd.filter("doc_id not in (8, 9)")):
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(d), float(plain_score(model, t))) for d, t in texts)
        got = sorted((str(r.doc_id), r.score) for r in T.scored(df, model).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
