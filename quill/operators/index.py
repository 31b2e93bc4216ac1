"""Inverted index: postings, terms, lengths; representatives; appending; the current version of a stored index.

tables: docs (doc_id, doc_len, ...), postings (term, doc_id, tf), terms (term, df), stats (n_docs, avg_len: one row).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import composite_key, tokens
from ..sources.files import replace

# How often each field counts towards term frequency.
FIELD_WEIGHTS = {"title": 3, "regulation_type": 1, "number": 2, "heading": 2, "pasal": 1, "ayat": 1, "retrieval_text": 1}


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def close(self) -> None:
        """Frees what build(keep=True) keeps in the session."""
        self.docs.unpersist()
        self.postings.unpersist()


def weighted_tokens(weights: Mapping[str, int], stopwords: Sequence[str] = ()) -> Column:
    """Tokens of several fields, a field's as often as it weighs; each field is tokenised once."""
    return F.flatten(F.array(*[F.flatten(F.array_repeat(tokens(F.col(f), stopwords), n)) for f, n in weights.items()]))


def build(docs: DataFrame, key: str = "doc_id", weights: Mapping[str, int] | None = None, stopwords: Sequence[str] = (), keep: bool = False) -> Index:
    """docs has the fields of weights. A document's postings and its length, its number of tokens, are made from its row
    alone and need no shuffle; only where ids repeat, which is looked at first, are rows counted together. keep: documents
    and postings are kept by the session, for an index that several searches use and that isn't worth writing; large ones
    are written by write() and read back."""
    counted = docs.withColumn("_tokens", weighted_tokens(weights or {"text": 1}, stopwords))
    with_len = counted.withColumn("doc_len", F.size("_tokens").cast("long")).drop("_tokens")
    if repeated(docs, key):
        postings = counted.select(key, F.explode("_tokens").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf")
    else:
        ordered = counted.select(key, F.sort_array("_tokens").alias("_s"))
        headed = ordered.select(key, "_s", run_heads("_s").alias("_h"))
        run = F.transform("_h", lambda i, k: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_h", k + 1), F.size("_s")) - i).cast("long").alias("tf")))
        postings = headed.select(key, F.explode(run).alias("_r")).select("_r.term", key, "_r.tf")
    if keep:
        with_len, postings = with_len.persist(), postings.persist()
    return Index(with_len, postings, counted_terms(postings), lengths(with_len))


def with_counts(rows: DataFrame) -> DataFrame:
    """rows with _counts instead of the array _tokens: its different values and how often each is in it, (term, tf), by the term."""
    headed = rows.withColumn("_s", F.sort_array("_tokens")).drop("_tokens").withColumn("_h", run_heads("_s"))
    run = F.transform("_h", lambda i, k: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_h", k + 1), F.size("_s")) - i).cast("long").alias("tf")))
    return headed.withColumn("_counts", run).drop("_s", "_h")


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether an id has several rows; ids alone are read."""
    return docs.groupBy(key).count().where("count > 1").limit(1).count() > 0


def run_heads(ordered: str, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """The places, from 0, at which a sorted array's value (of its elements) is another than before."""
    def head(i: Column) -> Column:
        return (i == 0) | (of(F.get(ordered, i)) != of(F.get(ordered, i - 1)))

    return F.when(F.size(ordered) > 0, F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), head)).otherwise(F.array().cast("array<int>"))


def counted_terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def append(old: Index, new: Index, key: str = "doc_id") -> Index:
    """The index of both; counts of terms and the mean length are merged, the postings are immutable. New ids must be new."""
    terms = old.terms.unionByName(new.terms).groupBy("term").agg(F.sum("df").alias("df"))
    both = old.stats.unionByName(new.stats)
    stats = both.agg(F.sum("n_docs").alias("n_docs"), (F.sum(F.col("n_docs") * F.col("avg_len")) / F.sum("n_docs")).alias("avg_len"))
    return Index(old.docs.unionByName(new.docs, allowMissingColumns=True), old.postings.unionByName(new.postings), terms, stats)


def representative_rank(admission: Column, quality: Column, page: Column, block_type: Column, text: Column) -> Column:
    """Sort key of a document's best unit: list aggregates, then the most exact citation, first page, block type, shortest text."""
    # Fixed values.
    qualities = ["document_page_pasal_ayat_huruf", "document_page_pasal_ayat", "document_page_pasal", "document_page", "document_only"]
    types = ["article", "paragraph", "heading", "list_item", "table_or_row", "qa_or_faq"]

    def place(c: Column, names: list[str]) -> Column:
        at = F.array_position(F.array(*map(F.lit, names)), F.coalesce(c, F.lit("")))
        return F.when(at > 0, at - 1).otherwise(9)

    return F.struct(
        F.when(admission == "enumeration_aggregate", 0).otherwise(1), place(quality, qualities), F.coalesce(page, F.lit(999999)), place(block_type, types), F.length(F.coalesce(text, F.lit("")))
    )


def representatives(units: DataFrame, keys: Sequence[str], rank: Column, tie: str) -> DataFrame:
    """The unit with the least rank of each document; an aggregate, so only one row a key and task is shuffled."""
    rest = [c for c in units.columns if c not in keys]
    best = units.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), F.col(tie).alias("t"))).alias("best"))
    return best.select(*keys, "best.*")


def lookup(units: DataFrame, keys: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first unit, in `order`, of each document that keys names: an aggregate, so one row a key and task is shuffled."""
    wanted = keys.select(key).distinct()
    return representatives(units.join(wanted, key, "left_semi"), [key], F.struct(*order), order[-1])


def document_key(*cols: str) -> Column:
    return composite_key(*map(F.col, cols))


def write(index: Index, path: str, buckets: int = 64) -> None:
    """Each table under path, which appears as a whole or not at all; postings lie sorted by term in hash partitions of it,
    so that a few terms read a few row groups. The counts of terms and lengths are made from what has been written."""
    spark = index.docs.sparkSession
    temp = f"{path}.building-{uuid.uuid4().hex}"
    index.docs.write.parquet(f"{temp}/docs")
    index.postings.repartition(buckets, "term").sortWithinPartitions("term", "doc_id").write.parquet(f"{temp}/postings")
    postings, docs = spark.read.parquet(f"{temp}/postings"), spark.read.parquet(f"{temp}/docs")
    counted_terms(postings).repartition(buckets, "term").sortWithinPartitions("term").write.parquet(f"{temp}/terms")
    lengths(docs).write.parquet(f"{temp}/stats")
    replace(spark, temp, path)


def read(spark, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "terms", "stats")])


def ordinal(partition: Sequence[str], order: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
