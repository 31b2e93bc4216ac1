import random

import pytest
from pyspark.sql import functions as F

from quill.functions import scoring
from quill.functions.text import normalize_space, tokens
from quill.operators import search


@pytest.mark.parametrize("with_runs", [True, False])
def test_no_pair_that_scores_enough_is_missed(spark, with_runs):
    """Against the score of every pair."""
    rng = random.Random(8)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh/ii", "x", "jj", *(f"w{i}" for i in range(25))]

    def some(n):
        return " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))

    titles = [(i, some(rng.choice([1, 3, 6, 12, 25]))) for i in range(150)]
    asked = [(i, some(rng.choice([1, 4, 8, 30]))) for i in range(25)] + [(90 + i, t + " zz") for i, (_, t) in enumerate(titles[:8])] + [(200, ""), (201, None)]
    asked += [(300 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t) in enumerate(titles[8:30])]  # shuffled: no runs
    t = spark.createDataFrame([*titles, (999, None)], "doc_id long, title string")
    s = spark.createDataFrame(asked, "search_id long, query string")
    low = [F.lower(normalize_space(F.col(c))) for c in ("query", "title")]
    score = scoring.title_score(low[0], tokens(low[0]), low[1], tokens(low[1]), with_runs)
    want = s.crossJoin(t).select("search_id", "doc_id", F.round(score, 6)).where(score >= scoring.TITLE_MIN_SCORE).collect()
    got = search.title_search(t, s, with_runs=with_runs).select("search_id", "doc_id", F.round("title_score", 6)).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("with_runs", [True, False])
def test_titles_are_scored_in_their_tasks_with_the_rows_of_the_joins(spark, monkeypatch, with_runs):
    rng = random.Random(9)
    words = ["aa", "bb", "cc/dd", "x", "dd", *(f"w{i}" for i in range(20))]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.choice([0, 1, 2, 6, 20, 60])))) for i in range(120)]
    t = spark.createDataFrame(rows, "doc_id long, title string")
    s = spark.createDataFrame([(f"s{i}", title) for i, title in rows[:30]], "search_id string, query string")
    monkeypatch.setattr(search, "DENSE", 100)  # a batch is scored in many parts

    def found():
        return search.title_search(t, s, with_runs=with_runs)

    by_title = found()
    assert "Exchange" not in by_title._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 10)
    by_pair = found()
    assert "Exchange" in by_pair._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(tuple, x.collect())) for x in (by_title, by_pair))
    assert got == want and len(got) > 100


def test_near_best_makes_its_rows_once(spark):
    rows = spark.createDataFrame([(1, 1, 80.0), (1, 2, 60.0), (1, 3, 59.9), (2, 4, 1.0), (None, 5, 9.0)], "search_id int, doc_id int, score double")
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    near = search.near_best(rows.coalesce(1).mapInArrow(pass_on, rows.schema), "score")
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 2, 4] and made.value == rows.count()
