"""Benchmark decontamination (1): which documents contain which test items. Built-in expressions only.

Containment of an item in a document is the share of the item's distinct word shingles that occur in the document.
Items are partitioned by size, in classes of doubling shingle counts. Each item keeps a bottom-k MinHash sketch, its k
smallest shingle hashes, and the class's upper bound u sets k = u - ceil(t u) + 1: an item of n <= u shingles that is
contained to t misses at most n - ceil(t n) of them, so at least one of any k is in the document, and the search loses
nothing. A document is never sketched: its shingles stream past the sketches, however long it is, and a class's lower
bound rules out documents that are too short for it. Candidates are then verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of sketches, or of candidates (three numbers each), up to which they are broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 500_000


def normal(text: Column) -> Column:
    """Lower case, runs of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _hashes(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order; none if there are fewer words."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))


def item_shingles(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """(iid, item, k, n, shingle, h) for every distinct shingle; iid stands for an id with its text. An item of fewer than k words is one shingle of all its words, one without words has none."""
    w = items.select(F.xxhash64(item_col, text_col).alias("iid"), F.col(item_col).alias("item"), _words(normal(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(k)))
    sh = w.select("iid", "item", "k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.slice("w", i, F.col("k"))))).alias("s"))
    sh = sh.select("iid", "item", "k", F.array_join("s", " ").alias("shingle"), F.xxhash64("s").alias("h")).distinct()
    sizes = sh.groupBy("iid").agg(F.count(F.lit(1)).alias("n"))
    return sh.join(sizes, "iid")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id, item, n_shingles, n_found, containment) of every pair contained to the threshold, each pair once.

    Null or empty texts and items contain nothing and are contained in nothing. Rows that repeat an id are searched each
    for itself, and so are items that repeat one; a pair keeps the best of them. Null ids of documents and items are ids
    like others. Other columns are ignored.
    """
    shingles = materialize(item_shingles(items, item_col, item_text_col, k), "shingles")
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    sketches = materialize(
        shingles.withColumn("rank", F.row_number().over(_by_hash()))
        .where(F.col("rank") <= upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1)
        .select("iid", "k", "h", F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), F.floor(F.log2("n"))) - 1e-9).alias("least")),
        "sketches",
    )
    few = sketches.count() <= BROADCAST_ROWS
    lengths = [r[0] for r in sketches.select("k").distinct().collect()]  # at most k numbers
    raw = F.coalesce(F.col(text_col), F.lit(""))
    text = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), F.xxhash64(raw).alias("tid"))
    w = text.select("id", "tid", _words(normal(F.col("raw"))).alias("w"))
    hashed = None
    for size in lengths:
        one = w.select("id", "tid", F.size("w").alias("n_words"), F.explode(_hashes(F.col("w"), size)).alias("h")).withColumn("k", F.lit(size))
        hashed = one if hashed is None else hashed.union(one)
    if hashed is None:
        return text.limit(0).select("id", F.lit(None).cast(items.schema[item_col].dataType).alias("item"), *[F.lit(0).cast("long").alias(c) for c in ("n_shingles", "n_found")], F.lit(0.0).alias("containment"))
    found = hashed.join(F.broadcast(sketches) if few else sketches, ["h", "k"]).where(F.col("n_words") - F.col("k") + 1 >= F.col("least"))
    found = materialize(found.select(F.col("id").alias("cid"), F.col("tid").alias("ctid"), "iid").distinct(), "found")
    # texts without a candidate are left out where they lie, unless candidates are too many to be sent to them
    met = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    whole = shingles.groupBy("iid", "item", "n").agg(F.collect_list("shingle").alias("shingles"))  # the shingles of one test item
    named = text.join(met, F.col("id").eqNullSafe(F.col("cid")) & (F.col("tid") == F.col("ctid"))).join(F.broadcast(whole) if few else whole, "iid")
    # the text is a lambda's variable, so that it is normalised once and not once a shingle
    padded = F.array(F.concat(F.lit(" "), normal(F.col("raw")), F.lit(" ")))
    has = F.transform(padded, lambda t: F.size(F.filter("shingles", lambda s: F.contains(t, F.concat(F.lit(" "), s, F.lit(" "))))))
    checked = (
        named.select("id", "item", F.col("n").alias("n_shingles"), has[0].cast("long").alias("n_found"))
        .where(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
    )
    best = checked.groupBy("id", "item").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_found", "n_shingles")).alias("best"))
    return best.select("id", "item", "best.n_shingles", "best.n_found", "best.containment")


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("iid").orderBy("h", "shingle")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_found", "containment")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
s AS (SELECT DISTINCT r, item_id, array_to_string(w[j : j + 4], ' ') AS shingle FROM (SELECT r, item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM i WHERE w[1] <> '')),
n AS (SELECT r, count(*) AS n_shingles FROM s GROUP BY r),
f AS (SELECT d.doc_id, s.item_id, s.r, count(DISTINCT s.shingle) AS n_found FROM d JOIN s ON contains(d.t, ' ' || s.shingle || ' ') GROUP BY d.doc_id, s.item_id, s.r),
b AS (SELECT doc_id, item_id, max({'c': n_found / n_shingles, 'f': n_found, 'n': n_shingles}) AS b FROM f JOIN n USING (r) WHERE n_found >= ceil(0.8 * n_shingles - 1e-9) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, b.n AS n_shingles, b.f AS n_found, b.c AS containment FROM b
"""
