"""Evidence: support, groups by document, confidence of a question's best items, coverage by issuer, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WEIGHTS = {"primary_rate": 0.25, "page_rate": 0.20, "article_rate": 0.15, "phrase_rate": 0.15, "lexical_rate": 0.15, "query_coverage": 0.10, "issuer_rate": 0.05}
STRONG, PARTIAL, RECOVERED = 0.78, 0.55, 0.70


def group_top(items: DataFrame, keys: Sequence[str], per_group: int, score: str, tie: str, by: str = "query_id") -> DataFrame:
    """(by, keys, best, n, items) with at most per_group items a document, those of the best score first."""
    w = Window.partitionBy(by, *keys).orderBy(F.round(score, 6).desc(), tie)
    kept = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group)
    return kept.groupBy(by, *keys).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_n", tie))), lambda x: x[tie]).alias("items"))


def confidence(items: DataFrame, by: str = "query_id", top: int = 5, order: Sequence[Column] = ()) -> DataFrame:
    """items: is_primary, has_page, has_article, lexical_support, phrases (a count), coverage (of the query), issuer_hit,
    ambiguous, exact_support, has_topic. One row a question: score, label, must_say_not_found.

    The ladder's order matters: thresholds, then what makes weak, then what makes partial again."""
    w = Window.partitionBy(by).orderBy(*order)
    best = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    rates = best.groupBy(by).agg(
        F.avg(F.col("is_primary").cast("int")).alias("primary_rate"), F.avg(F.col("has_page").cast("int")).alias("page_rate"), F.avg(F.col("has_article").cast("int")).alias("article_rate"),
        F.least(F.lit(1.0), F.sum("phrases") / 2.0).alias("phrase_rate"), F.avg("lexical_support").alias("lexical_rate"), F.max("coverage").alias("query_coverage"), F.max(F.col("issuer_hit").cast("int")).cast("double").alias("issuer_rate"),
        F.sum("phrases").alias("phrase_count"), F.max("ambiguous").alias("ambiguous"), F.max("exact_support").alias("exact_support"), F.max("has_topic").alias("has_topic"),
    )
    score = sum((F.lit(v) * F.col(k) for k, v in WEIGHTS.items()), F.lit(0.0))
    free = ~F.col("ambiguous") & ~F.col("exact_support") & (F.col("phrase_count") == 0)
    generic = free & ~F.col("has_topic") & ((F.col("query_coverage") < 0.75) | (F.col("lexical_rate") < 0.55))
    low = free & (F.col("query_coverage") < 0.65) & (F.col("lexical_rate") < 0.50)
    first = F.when(score >= STRONG, "strong").when(score >= PARTIAL, "partial").otherwise("weak")
    weak = F.when(generic | low, "weak").otherwise(first)
    label = F.when((weak == "weak") & (score >= RECOVERED) & F.col("has_topic"), "partial").otherwise(weak)
    return rates.select(by, F.round(F.least(F.lit(1.0), score), 6).alias("score"), label.alias("label"), (label == "weak").alias("must_say_not_found"))


def issuer_coverage(items: DataFrame, expected: DataFrame, by: str = "query_id") -> DataFrame:
    """expected: (by, issuer). direct, adjacent_only or missing for each, from items' booleans direct and adjacent."""
    seen = items.groupBy(by, "issuer").agg(F.max("direct").alias("direct"), F.max("adjacent").alias("adjacent"))
    return expected.join(seen, [by, "issuer"], "left").select(by, "issuer", F.when(F.col("direct"), "direct").when(F.col("adjacent"), "adjacent_only").otherwise("missing").alias("label"))


def gate_by_coverage(confident: DataFrame, coverage: DataFrame, by: str = "query_id") -> DataFrame:
    """A question with an issuer that isn't covered directly is answered partially."""
    missing = coverage.where("label <> 'direct'").groupBy(by).agg(F.array_sort(F.collect_set("issuer")).alias("missing_direct_issuers"))
    out = confident.join(missing, by, "left")
    gated = F.col("missing_direct_issuers").isNotNull()
    return out.withColumn("previous_label", F.when(gated, F.col("label"))).withColumn("label", F.when(gated, "partial").otherwise(F.col("label"))).withColumn("must_say_not_found", F.col("must_say_not_found") & ~gated)


def select_findings(items: DataFrame, most: int = 3, per_document: int = 3, share: float = 0.60, by: str = "query_id", pool: int = 64) -> DataFrame:
    """items: rank, usable, issuer, required (the question asks for the issuer), document, citation, title_overlap, block.

    Up to `most` usable items: one of each required issuer first, then by rank, each citation once and at most
    per_document of a document; items far below the best title overlap are out if that is one or more. The choice is
    greedy, so a question's best `pool` items are chosen from in one array expression.
    """
    ok = items.where("usable")
    best = F.max("title_overlap").over(Window.partitionBy(by))
    near = ok.withColumn("_best", best).where((F.col("_best") < 1.0) | (F.col("title_overlap") >= share * F.col("_best")))
    order = [F.round("rank", 6).desc(), F.col("block")]
    once = near.withColumn("_c", F.row_number().over(Window.partitionBy(by, "citation").orderBy(*order))).where("_c = 1")
    lead = F.col("required") & (F.row_number().over(Window.partitionBy(by, "issuer").orderBy(*order)) == 1)
    first = once.withColumn("_late", (~lead).cast("int"))
    few = first.withColumn("_d", F.row_number().over(Window.partitionBy(by, "document").orderBy("_late", *order))).where(F.col("_d") <= per_document)
    place = few.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_late", *order))).where(F.col("place") <= most)
    return place.drop("_best", "_c", "_late", "_d")


def answers(findings: DataFrame, questions: DataFrame, by: str = "query_id") -> DataFrame:
    """One row a question: status, findings, citations. Without a finding the answer is not_found, whatever the label."""
    listed = findings.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("f"), F.col("place").cast("string")).alias("id"), F.col("claim").alias("text"), F.concat(F.lit("c"), F.col("place").cast("string")).alias("citation_id"), "document", "block"))).alias("findings")
    )
    out = questions.join(listed, by, "left")
    status = F.when(F.col("findings").isNull() | F.col("must_say_not_found"), "not_found").when((F.col("label") == "partial") | F.col("ambiguity").isNotNull(), "partial").otherwise("answerable")
    found = F.when(status != "not_found", F.col("findings"))
    summary = F.when(status == "not_found", "Tidak ditemukan dalam dokumen yang tersedia.").otherwise(F.concat(F.lit("Ketentuan yang paling relevan ditemukan dalam "), F.col("findings")[0]["document"], F.lit(".")))
    return out.select(by, status.alias("status"), summary.alias("summary"), F.coalesce(F.transform(found, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["citation_id"].alias("citation_id"), x["block"].alias("block"))), F.array()).alias("findings"))


def trace(items: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, dimension, value, n) over citation quality, flags and issuers of a question's items."""
    pairs = F.concat(
        F.array(F.struct(F.lit("quality").alias("dimension"), F.col("citation_quality").alias("value")), F.struct(F.lit("issuer").alias("dimension"), F.col("issuer").alias("value"))),
        F.transform("flags", lambda f: F.struct(F.lit("flag").alias("dimension"), f.alias("value"))),
    )
    return items.select(by, F.explode(pairs).alias("p")).groupBy(by, "p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
