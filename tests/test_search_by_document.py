import random

import pytest
from pyspark.sql import functions as F

from quill.operators import index, search

WORDS = [f"w{i}" for i in range(30)]


def made(spark, copies=1):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, range(30, 0, -1), k=rng.randrange(0, 40))), rng.choice(["BI", "OJK", None]), rng.choice(["en", "id", None])) for i in range(400)]
    rows += [(1000 + i, rows[7][1], "BI", "en") for i in range(20)] + [(2000, None, "BI", "en")]
    docs = spark.createDataFrame(rows * copies, "doc_id long, text string, issuer string, lang string")
    asked = [(f"s{i}", " ".join(rng.choices(WORDS, k=i % 9 + 1)), rng.choice(["BI", "OJK", "none", None])) for i in range(12)] + [("empty", "", None), ("unknown", "qq rr w3", None)]
    return index.build(docs), spark.createDataFrame(asked, "search_id string, query string, issuer string")


def rows(found):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in found.select("search_id", "doc_id", "matched", "bm25").collect())


@pytest.mark.parametrize("copies", [1, 2])
def test_hits_are_those_of_the_joins(spark, monkeypatch, copies):
    """Filters, scopes, nulls, ties of copies, ids that repeat; documents scored a few at once."""
    ix, asked = made(spark, copies)
    scope = spark.createDataFrame([("s1", "en"), ("s1", "id"), ("s2", "en"), ("s3", "xx"), ("s4", None)], "search_id string, lang string")
    cases = ({"min_match": False, "limit": 7}, {"scope": scope, "scope_key": "lang", "filters": ("issuer",)})
    got = []
    for options in cases:
        for dense in (100, 1 << 20):
            monkeypatch.setattr(search, "DENSE", dense)
            got.append(rows(search.bm25(ix, asked, **options)))
    monkeypatch.setattr(search, "BROADCAST_TERMS", 1)
    want = [rows(search.bm25(ix, asked, **options)) for options in cases]
    assert got == [want[0], want[0], want[1], want[1]] and all(want)


def test_many_hits_are_not_joined_to_the_postings(spark, monkeypatch):
    """More hits than are broadcast, of few searches: before, each posting was joined and shuffled once a search."""
    ix, asked = made(spark)
    monkeypatch.setattr(search, "BROADCAST_TERMS", 100)
    found = search.bm25(ix, asked, min_match=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 1000 and "MapInArrow" in plan and "SortMergeJoin" not in plan and "search_id, " not in plan.split("MapInArrow")[1]


def test_tasks_hand_on_their_best_alone(spark):
    ix, asked = made(spark)
    terms, _ = search.held(search.candidates(search.search_terms(asked), ix))
    assert search._by_document(ix, terms, None, (), False, None, "file_id", 2).groupBy("search_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] == 2
