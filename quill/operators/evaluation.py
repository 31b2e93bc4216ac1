"""Evaluation: targets against citations, weighted checks, summaries, ranked-retrieval measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CHECKS = {
    "status": 0.15, "answer_terms": 0.15, "exact_targets": 0.30, "citation_precision": 0.15, "provenance": 0.10, "required_issuers": 0.05, "citation_count": 0.05, "uncertainty": 0.03, "forbidden_terms": 0.02,
}
ACCEPTED, PRECISION = 0.90, 0.67


def target_matches(citations: DataFrame, variants: DataFrame, keys: Sequence[str] = ("issuer", "file_id"), terms: bool = True) -> DataFrame:
    """Citations and variants of one issuer and file whose pages overlap and whose texts have all the variant's terms.
    citations: page_start, page_end, text; variants: target_start, target_end, text_terms."""
    pages = (F.col("page_end") >= F.col("target_start")) & (F.col("page_start") <= F.col("target_end"))
    out = citations.join(variants, list(keys)).where(pages)
    return out.where(F.forall("text_terms", lambda t: F.contains(F.lower("text"), F.lower(t)))) if terms else out


def missing_targets(variants: DataFrame, matches: DataFrame, key: Sequence[str]) -> DataFrame:
    return variants.join(matches.select(*key).distinct(), list(key), "left_anti")


def weighted_checks(rows: DataFrame, weights: Mapping[str, float] = CHECKS, accepted: float = ACCEPTED, hard: Sequence[str] | None = None) -> DataFrame:
    """rows with a boolean for each check: score, accepted, failures (hard checks that failed; all are hard by default)."""
    score = sum((F.when(F.col(k), v).otherwise(0.0) for k, v in weights.items()), F.lit(0.0))
    failed = F.array_compact(F.array(*[F.when(~F.col(k), k) for k in (hard or weights)]))
    return rows.withColumn("score", F.round(score, 3)).withColumn("failures", failed).withColumn("accepted", (F.round(score, 9) >= accepted) & (F.size("failures") == 0))


def summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count_if("accepted").alias("accepted"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("accepted").cast("int")), 3).alias("acceptance_rate"), F.round(F.avg("score"), 3).alias("average_score")
    )


def latencies(rows: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation, maximum and total."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, q), 3).alias(f"p{round(q * 100)}") for q in quantiles], F.round(F.max(value), 3).alias("max"), F.round(F.sum(value), 3).alias("total"))


def deltas(current: DataFrame, prior: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """current less prior for the metrics of either; a missing one counts as 0."""
    both = current.select(key, F.col(value).alias("_c")).join(prior.select(key, F.col(value).alias("_p")), key, "full_outer")
    return both.select(key, F.col("_c").alias("current"), F.col("_p").alias("prior"), (F.coalesce("_c", F.lit(0)) - F.coalesce("_p", F.lit(0))).alias("delta"))


def ranked(results: DataFrame, relevant: DataFrame, query: str, doc: str, rank: str, k: int = 10) -> DataFrame:
    """(query, recall, rr, ndcg) at k with binary relevance, for every query that has a relevant document."""
    marked = results.where(F.col(rank) <= k).join(relevant.select(query, doc).distinct().withColumn("_rel", F.lit(1)), [query, doc])
    gains = marked.groupBy(query).agg(F.count(F.lit(1)).alias("_hits"), F.min(rank).alias("_first"), F.sum(F.lit(1.0) / F.log2(F.col(rank) + 1)).alias("_dcg"))
    need = relevant.select(query, doc).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1))
    out = need.join(gains, query, "left")
    return out.select(query, (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def has_provenance(file_id: Column, block_id: Column, sources: Column, page_start: Column, page_end: Column) -> Column:
    return file_id.isNotNull() & block_id.isNotNull() & (F.size(sources) > 0) & (page_start > 0) & (F.coalesce(page_end, page_start) >= page_start)


def contract(findings: Column, citations: Column) -> Column:
    """Struct of booleans: every finding's citation is there, ids are unique, every citation is used."""
    used, ids = F.transform(findings, lambda f: f["citation_id"]), F.transform(citations, lambda c: c["id"])
    return F.struct(
        (F.size(F.array_except(used, ids)) == 0).alias("citations_exist"), (F.size(F.array_distinct(ids)) == F.size(ids)).alias("citations_unique"),
        (F.size(F.array_distinct(F.transform(findings, lambda f: f["id"]))) == F.size(findings)).alias("findings_unique"), (F.size(F.array_except(ids, used)) == 0).alias("citations_used"),
    )


def select_cases(cases: DataFrame, tier: str | None = None, ids: Sequence[str] = (), categories: Sequence[str] = (), limit: int | None = None, order: str = "position") -> DataFrame:
    out = cases
    if tier:
        out = out.where(F.array_contains("tiers", tier))
    if ids:
        out = out.where(F.col("id").isin(list(ids)))
    if categories:
        out = out.where(F.col("category").isin(list(categories)))
    if limit is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.orderBy(order))).where(F.col("_n") <= limit).drop("_n")
