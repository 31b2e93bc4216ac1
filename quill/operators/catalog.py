"""Catalogue: duplicates among primary files, coverage between sources, replacing by key, audits of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash


def annotate_duplicates(files: DataFrame, canonical: str, digest: str, key: str, preferred: Column) -> DataFrame:
    """Adds searchable, duplicate_status, group_id, duplicate_of and group_size. Files with one canonical id and digest
    are a group; its preferred file (least `preferred`, then least key) stays searchable. Groups are aggregates joined
    back, so no group is sorted in one task."""
    grouped = F.col(canonical).isNotNull() & F.col(digest).isNotNull()
    best = files.where(grouped).groupBy(canonical, digest).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(preferred.alias("p"), F.col(key).alias("k")))["k"].alias("_best")).where("_n > 1")
    out = files.join(best, [canonical, digest], "left")
    return out.select(
        *files.columns,
        F.coalesce(F.col(key) == F.col("_best"), F.lit(True)).alias("searchable"),
        F.when(F.col("_n").isNull(), "unique").when(F.col(key) == F.col("_best"), "preferred").otherwise("duplicate").alias("duplicate_status"),
        F.when(F.col("_n").isNotNull(), F.concat(F.lit("primary-duplicate-"), short_hash(F.concat_ws(":", canonical, digest)))).alias("group_id"),
        F.when(F.col(key) != F.col("_best"), F.col("_best")).alias("duplicate_of"),
        F.coalesce("_n", F.lit(1)).alias("group_size"),
    )


def worth_hashing(files: DataFrame, canonical: str, size: str) -> DataFrame:
    """Files that share canonical id and size with another: the only ones whose content needs a digest."""
    groups = files.where(F.col(size).isNotNull()).groupBy(canonical, size).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return files.join(groups.drop("_n"), [canonical, size], "left_semi")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right; nulls aren't keys."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only")
    )


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys, and new."""
    return old.join(keys.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def resolve_paths(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files.saved_path against a listing (path, basename): the path itself, then a file of its name; adds resolved_path, exists, error."""
    named = files.withColumn("_base", F.regexp_extract("saved_path", r"([^/]+)$", 1))
    exact = listing.select(F.col("path").alias("saved_path"), F.lit(True).alias("_exact")).distinct()
    by_name = listing.groupBy(F.col("basename").alias("_base")).agg(F.min("path").alias("_named"))
    out = named.join(exact, "saved_path", "left").join(by_name, "_base", "left")
    found = F.when(F.col("_exact"), F.col("saved_path")).otherwise(F.col("_named"))
    empty = F.coalesce(F.col("saved_path") == "", F.lit(True))
    return out.select(
        *files.columns,
        F.when(~empty, F.coalesce(found, "saved_path")).alias("resolved_path"),
        (~empty & found.isNotNull()).alias("exists"),
        F.when(empty, "missing_saved_path").when(found.isNull(), "file_not_found").alias("error"),
    )


def profile(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, n) of each dimension in one pass: grouping sets of one column each."""
    one = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x"))
    return one.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null); '' counts as null."""
    sums = rows.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.*")


def duplicate_groups(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rule_audit(rows: DataFrame, rules: dict[str, Column], order: Sequence[str], examples: int = 5, example: str | None = None) -> DataFrame:
    """(rule, violations, examples) of rules that rows break; examples are the first in `order`, kept bounded while counting."""
    broken = rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"), *order)
    counts = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    first = broken.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).where(F.col("_n") <= examples)
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.col(example or order[0]).cast("string"))).alias("examples"))
    return counts.join(shown, "rule")


def build_corpus(units: DataFrame, extracted: DataFrame, metadata: DataFrame, file_key: str, block_key: str, meta_key: str, reason: Column) -> DataFrame:
    """Units of extracted files without a reason to stay out, with their metadata, each (file, block) once."""
    admitted = units.join(extracted.select(file_key).distinct(), file_key, "left_semi").where(reason.isNull())
    return admitted.dropDuplicates([file_key, block_key]).join(metadata, meta_key, "left")
