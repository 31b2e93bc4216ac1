import datetime
import random

import pytest
from pyspark.sql import functions as F

from quill.operators import temporal


def tables(spark, seed=1, share=0.5):
    """Rows with ties, repeats, null keys and times; one key has `share` of both sides."""
    rng = random.Random(seed)

    def rows(n):
        return [(i, 7 if rng.random() < share else rng.choice([None, 1, 2, 3]), rng.choice([None, *range(60)] if rng.random() < 0.1 else range(60)), rng.choice("abc")) for i in range(n)]

    left, right = rows(120) + [(5, 1, 30, "x")] * 2, rows(150)
    kinds = "id long, k long, t long, v string"
    return left, right, spark.createDataFrame(left, kinds).repartition(4), spark.createDataFrame(right, kinds).repartition(3)


def brute_as_of(left, right, tolerance=None):
    out = []
    for r in left:
        fit = [x for x in right if r[1] is not None and r[2] is not None and x[1] == r[1] and x[2] is not None and x[2] <= r[2]]
        last = max(fit, key=lambda x: (x[2], x[0]), default=None)
        if last is not None and tolerance is not None and r[2] - last[2] > tolerance:
            last = None
        out.append((*r, last and (last[0], last[2], last[3])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10**6, 20, 3])
@pytest.mark.parametrize("tolerance", [None, 1])
def test_as_of(spark, most, tolerance):
    left, right, a, b = tables(spark)
    got = temporal.as_of(a, b, ["k"], "t", "t", tolerance=tolerance, most=most)
    assert got.columns == ["id", "k", "t", "v", "match"]
    mine = sorted(((r["id"], r["k"], r["t"], r["v"], r["match"] and tuple(r["match"])) for r in got.collect()), key=str)
    assert mine == brute_as_of(left, right, tolerance)


def test_a_hot_key_is_cut_into_windows(spark):
    n = 4000
    both = spark.range(n).select(F.lit(1).alias("_k0"), F.col("id").alias("_t"))
    cuts = temporal._cuts(both, ["_k0"], 500).first()["_cuts"]
    sizes = [b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    assert len(cuts) == 7 and max(sizes) <= 550


def test_as_of_kinds_of_time(spark):
    day = datetime.date(2024, 1, 1)
    a = spark.createDataFrame([(1, day), (1, datetime.date(2024, 3, 1))], "k long, d date")
    b = spark.createDataFrame([(1, day, "x")], "k long, d date, k0 string")
    got = temporal.as_of(a, b, ["k"], "d", "d", tolerance=30, most=1).orderBy("d").collect()
    assert [r["match"] and r["match"]["k0"] for r in got] == ["x", None]
    as_time = [df.withColumn("d", F.col("d").cast("timestamp_ntz")) for df in (a, b)]
    got = temporal.as_of(*as_time, ["k"], "d", "d", tolerance=30 * 86400 * 10**6).orderBy("d").collect()
    assert [r["match"] and r["match"]["k0"] for r in got] == ["x", None]


def test_as_of_empty_sides(spark):
    _, _, a, b = tables(spark)
    assert temporal.as_of(a.limit(0), b, ["k"], "t", "t").count() == 0
    alone = temporal.as_of(a, b.limit(0), ["k"], "t", "t", most=5)
    assert alone.count() == a.count() and alone.where("match IS NOT NULL").count() == 0


def test_as_of_shuffles_once(spark):
    _, _, a, b = tables(spark)
    plan = temporal.as_of(a, b, ["k"], "t", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("before", "after"), [(0, 0), (3, 0), (0, 4), (5, 2)])
def test_within(spark, before, after):
    left, right, a, b = tables(spark, 2)
    want = sorted(((*r, (x[0], x[2], x[3])) for r in left for x in right if None not in (r[1], r[2], x[2]) and r[1] == x[1] and r[2] - before <= x[2] <= r[2] + after), key=str)
    got = temporal.within(a, b, ["k"], "t", "t", before, after).collect()
    assert sorted(((r["id"], r["k"], r["t"], r["v"], tuple(r["match"])) for r in got), key=str) == want
