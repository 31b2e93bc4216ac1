import math

import numpy as np
import pytest

from quill.catalogue import QUERIES
from quill.catalogue.base import docs, searches
from quill.operators import index, search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [True, False])
def test_documents_without_a_rare_term_are_found(spark, monkeypatch, few):
    """Documents had to have one of a search's six rarest terms; with most=None any of its terms will do."""
    if not few:
        monkeypatch.setattr(search, "BROADCAST_TERMS", 1)
    texts = {0: [f"r{k}" for k in range(6)], **{i: ["aa", "bb"][: 1 + i % 2] + ["zz"] * i for i in range(1, 9)}, 9: ["zz"]}
    ix = index.build(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "aa bb bb " + " ".join(texts[0])), (2, "unknown bb"), (3, "unknown")], "search_id long, query string")
    got = {(r["search_id"], r["doc_id"]): (r["matched"], r["bm25"]) for r in search.bm25(ix, asked, min_match=False, most=None).collect()}
    mean, want = sum(map(len, texts.values())) / len(texts), {}
    for s, query in ((1, {"aa": 1, "bb": 2, **dict.fromkeys(texts[0], 1)}), (2, {"bb": 1})):
        for i, words in texts.items():
            parts = []
            for term, qf in query.items():
                df, tf = sum(term in t for t in texts.values()), words.count(term)
                if tf:
                    parts.append(qf * math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len(words) / mean)))
            if parts:
                want[s, i] = len(parts), pytest.approx(sum(parts))
    assert got == want and {i for s, i in got if s == 1} == set(range(9))
    assert {(r["search_id"], r["doc_id"]) for r in search.bm25(ix, asked, min_match=False).collect() if r["search_id"] == 1} == {(1, 0)}


def test_the_query_takes_documents_with_any_term(spark):
    places = {r["search_id"]: r["n"] for r in QUERIES["bm25_topk"](spark, SF).groupBy("search_id").agg({"rank": "max"}).withColumnRenamed("max(rank)", "n").collect()}
    postings = index.build(docs(spark, SF)).postings
    every = search.search_terms(searches(spark, SF)).join(postings, "term").select("search_id", "doc_id").distinct().groupBy("search_id").count().collect()
    assert places == {r["search_id"]: min(50, r["count"]) for r in every}


def test_the_best_of_each_search_are_kept():
    rng = np.random.default_rng(1)
    for limit in (1, 3, 100):
        at, score = rng.integers(0, 7, 200), np.round(rng.random(200), 2)
        kept = search.best_of_each(at, score, np.arange(200), limit)
        want = [i for s in range(7) for i in np.flatnonzero(at == s) if score[i] >= np.sort(score[at == s])[::-1][:limit][-1]]
        assert sorted(kept.tolist()) == sorted(want) and (np.diff(at[kept]) >= 0).all()
    assert len(search.best_of_each(at, score, np.arange(0), 3)) == 0
