import hashlib
import re
from collections import defaultdict

from panelcast.llm import line_dedup as D

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=3, min_chars=20):
    lower = str.maketrans(D.ascii_lower.__globals__["UPPER"], D.ascii_lower.__globals__["LOWER"])
    split = [(d, (t or "").split("\n")) for d, t in rows]
    held = defaultdict(set)
    key = lambda x: x.strip(BLANKS).translate(lower)
    rank = lambda d: float("-inf") if d is None else d
    for d, lines in split:
        for x in lines:
            held[key(x)].add(rank(d))
    out = []
    for d, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs
                                         and rank(d) != max(held[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in D.op7_line_dedup(df).collect()), key=str)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert digest(documents) == brute(rows)


def test_odd_rows(odd, empty):
    got = digest(odd)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert any(r[2] for r in got)
    assert digest(empty) == []


def test_batches_and_levels_do_not_change_the_result(documents):
    text = {r.doc_id: r.kept_text for r in D.dedup_lines(documents).collect()}
    other = D.dedup_lines(documents, batches=7, fanout=2)
    assert {r.doc_id: r.kept_text for r in other.collect()} == text


def test_runs_settle_common_keys(spark):
    runs = D.LineRuns(spark, min_docs=3, fanout=2)
    frame = lambda ids: spark.createDataFrame([(1, 1, k) for k in ids] + [(2, 2, ids[0])], "h1 long, h2 long, id long")
    for ids in ([90, 91, 92], [80, 81], [70]):
        runs.add(frame(ids))
    assert [(r.h1, r.keeper) for r in runs.frequent().orderBy("h1").collect()] == [(1, 92), (2, 90)]
    # the common key was settled by the first batch and never added again
    assert sum(r.n_docs for run in runs.runs() for r in run.filter("h1 = 1").collect()) == 3


def test_late_larger_id_still_wins(spark):
    runs = D.LineRuns(spark, min_docs=3)
    for ids in ([1, 2, 3], [9]):
        runs.add(spark.createDataFrame([(5, 5, k) for k in ids], "h1 long, h2 long, id long"))
    assert runs.frequent().first().keeper == 9


def test_stage_keeps_rows_and_columns(odd):
    out = D.line_dedup_stage(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.text for r in out.filter("doc_id = 1").collect()} == {"first text with a few words of its own"}
    assert out.filter("doc_id = 1").first().n_chars == len("first text with a few words of its own")
    assert out.filter("doc_id = 5").first().text is None


def test_plan_is_native(documents):
    plan = D.op7_line_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ids_at_both_ends_of_long(spark):
    """Differences of such ids do not fit into a long."""
    shared = "a line that every one of these documents holds"
    ids = [-(2**63) + 5, -9 * 10**18, -1, 0, 1, 9 * 10**18, 2**63 - 1]
    rows = [(k, f"{shared}\nown line of document {k}") for k in ids] + [(None, shared)]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    two = [(-(2**63), shared), (2**63 - 1, shared)]
    assert digest(spark.createDataFrame(two, "doc_id long, text string")) == brute(two)
