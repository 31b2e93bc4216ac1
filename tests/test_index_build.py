from collections import Counter

from quill.operators import index

ROWS = [(1, "aa bb aa"), (2, ""), (3, None), (4, "cc"), (5, "zz aa zz zz")]


def rows(ix):
    return sorted((r["term"], r["doc_id"], r["tf"]) for r in ix.postings.collect())


def test_postings_need_no_shuffle(spark):
    ix = index.build(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert rows(ix) == [("aa", 1, 2), ("aa", 5, 1), ("bb", 1, 1), ("cc", 4, 1), ("zz", 5, 3)]
    assert "Exchange" not in ix.postings._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_counted_together(spark):
    ix = index.build(spark.createDataFrame([*ROWS, (1, "aa cc")], "doc_id long, text string"))
    want = Counter()
    for i, text in [*ROWS, (1, "aa cc")]:
        want.update((t, i) for t in (text or "").split())
    assert rows(ix) == sorted((t, i, n) for (t, i), n in want.items())
