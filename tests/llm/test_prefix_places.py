from pyspark.sql import functions as F

from quill.llm import simhash


def test_pairs_that_meet_too_late_are_not_made(spark):
    """Of two texts of 100 shingles and similarity 0.8 each has 89 of the shared ones from the first of them on."""
    rows = [(1, 10, 100, 7, 5, 10), (1, 11, 100, 8, 11, 11), (2, 20, 100, 7, 12, 20), (2, 21, 100, 8, 3, 21)]
    shared = spark.createDataFrame(rows, "h long, node long, n int, before long, place int, head long").select("*", *[F.lit(0).cast("long").alias(c) for c in simhash.SKETCH])
    for forest in (True, False):
        assert [tuple(r) for r in simhash.shared_pairs(shared, 0.8, forest).collect()] == [(10, 11)]


def test_the_order_is_as_fine_for_many_texts(spark):
    """One text in eight is looked at, however many there are, so a shingle of 400 texts doesn't pass for rare among a million."""
    texts = spark.range(400).select(F.col("id").alias("node"), F.concat(F.lit("one common row of five words then number "), F.col("id").cast("string")).cast("binary").alias("t"))
    hashes, counts = simhash.common_shingles(texts, 5, 1_000_000)
    assert len(hashes) >= 4 and counts.max() > 20
