import random

from pyspark.sql import functions as F

from quill.operators import search


def plain(vectors, queries, limit):
    dot = F.aggregate(F.zip_with("embedding", "query_vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return search.top(vectors.crossJoin(queries).withColumn("score", dot).drop("embedding", "query_vector"), "score", limit, by=("query_id",), tie=("vec_id",))


def test_best_of_tasks_are_the_best_of_all(spark, monkeypatch):
    """Ties in rounded scores, copies, and vectors that are null, short or hold null, NaN or huge numbers."""
    monkeypatch.setattr(search, "PRODUCTS", 3)
    rng = random.Random(6)
    vectors = [[rng.choice([-1.0, 0.5, 0.0000005, 0.25, 1.0]) for _ in range(4)] for _ in range(300)]
    rows = [(i, i % 3, rng.choice(vectors)) for i in range(1500)] + [(2000, 1, None), (2001, 1, [1.0]), (2002, 2, [1.0, None, 1.0, 1.0]), (2003, 0, [float("nan")] * 4), (2004, 0, [1e200] * 4)]
    rows = [(i * 7 % 3001, label, v) for i, label, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id % 100 = 0 OR vec_id > 2990 OR embedding IS NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got, want = ([(r["query_id"], r["rank"], r["vec_id"], r["label"], None if r["score"] is None else repr(round(r["score"], 5))) for r in f(vectors, asked, 10).collect()] for f in (search.vector_top, plain))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 200


def test_rows_in_no_tasks_best_are_not_shuffled(spark):
    vectors = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding")).repartition(2)
    asked = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert "MapInArrow" in search.vector_top(vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert search.vector_top(vectors, asked, 3).count() == 15
