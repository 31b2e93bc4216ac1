"""Lexicon mining: weighted phrase candidates, confidence, generated entries, merging reviewed ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space, tokens

# Fixed values.
KINDS = "POJK|SEOJK|PBI|PADG|PADK|SEBI|UU|PP|PMK"
MARKERS = ("|", "---", "#", "!", "[](", "*)", "**")
WEIGHTS = {"title": 8.0, "heading": 2.0, "definition": 8.0, "alias": 7.0}
HIGH, MEDIUM = 16.0, 8.0
PARTS = 256


def normalize_phrase(c: Column) -> Column:
    """Without numbering, instrument prefixes and a parenthesis at the end."""
    v = normalize_space(c)
    for p in (r"^[#\-\d.)\s]+", r"^(?:[IVXLCDM]+|[A-Z])\.\s+", rf"(?i)^(?:{KINDS})\b[^-:–—]*[-:–—]\s*", rf"(?i)^(?:{KINDS})\s+(?:tentang|perihal)\s+", r"(?i)^(?:tentang|perihal)\s+", r"\s*\([^)]{1,80}\)\s*$"):
        v = F.regexp_replace(v, p, "")
    return normalize_space(F.regexp_replace(v, r"^[ .,:;/–—-]+|[ .,:;/–—-]+$", ""))


def valid_phrase(c: Column, generic: Sequence[str] = (), fragments: Sequence[str] = ()) -> Column:
    low = F.lower(c)
    ts = tokens(c)
    bad = F.lit(False)
    for m in MARKERS:
        bad = bad | F.contains(c, F.lit(m))
    for f in fragments:
        bad = bad | F.contains(low, F.lit(f))
    few = F.size(F.filter(ts, lambda t: t.isin(list(generic)))) if generic else F.lit(0)
    return F.length(low).between(3, 160) & ~bad & ~low.isin(list(generic) or [""]) & ~low.rlike(r"^[\d./\-\s]+$") & F.size(ts).between(1, 10) & (few < F.greatest(F.lit(1), F.floor(F.size(ts) / 2)))


def phrase_type(c: Column, entities: Sequence[str], topics: Sequence[str]) -> Column:
    def any_of(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(F.lower(c), F.lit(w))
        return out

    return F.when(any_of(entities), "entity").when(any_of(topics), "topic").when(c.rlike("^[A-Z0-9-]{2,12}$"), "alias").otherwise("topic")


def candidates(mentions: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """mentions: phrase, type, origin (title, heading, ...), issuer, role. One row for each (type, lower-case phrase):
    score, support, issuers, confidence. Phrases seen in headings alone count a tenth."""
    weight = F.lit(1.0)
    for k, v in weights.items():
        weight = F.when(F.col("origin") == k, v).otherwise(weight)
    grouped = mentions.groupBy("type", F.lower("phrase").alias("key")).agg(
        F.min("phrase").alias("phrase"), F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("support"), F.array_sort(F.collect_set("issuer")).alias("issuers"),
        F.max((F.col("role") == "primary_regulation").cast("int")).alias("_primary"), F.min((F.col("origin") == "heading").cast("int")).alias("_heading"),
    )
    score = F.col("_sum") * F.when(F.col("_heading") == 1, 0.1).otherwise(1.0) + 2.0 * F.col("_primary") + F.least(F.lit(2.0), F.size("issuers").cast("double"))
    scored = grouped.withColumn("score", score)
    return scored.select("type", "key", "phrase", "score", "support", "issuers", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low").alias("confidence"), (F.col("_heading") == 1).alias("heading_only"))


def generated(rows: DataFrame, least_score: float, least_support: int, limit: int = 300) -> DataFrame:
    """The best `limit` candidates of each type that are more than headings: a report of fixed size."""
    kept = rows.where((F.col("score") >= least_score) & (F.col("support") >= least_support) & ~F.col("heading_only"))
    order = [F.round("score", 6).desc(), F.col("key")]
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))  # the best of each part first, so that no task ranks them all
    some = kept.withColumn("_n", F.row_number().over(Window.partitionBy("type", part).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("place") <= limit)


def merge(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """base and reviewed: section, name, patterns; reviewed has approved. Approved entries whose name and patterns are new join the base."""
    ok = reviewed.where("approved").select("section", "name", "patterns")
    names = base.select("section", "name")
    taken = base.select("section", F.explode("patterns").alias("p")).select("section", F.lower("p").alias("p")).distinct()
    clash = ok.select("section", "name", F.explode("patterns").alias("p")).select("section", "name", F.lower("p").alias("p")).join(taken, ["section", "p"], "left_semi").select("section", "name").distinct()
    return base.select("section", "name", "patterns").unionByName(ok.join(names, ["section", "name"], "left_anti").join(clash, ["section", "name"], "left_anti"))


def add_aliases(base: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: section, name, patterns to add, approved. An update without a target fails the job."""
    added = updates.where("approved").groupBy("section", "name").agg(F.flatten(F.collect_list("patterns")).alias("_add"))
    out = base.join(added, ["section", "name"], "full_outer")
    return out.select("section", "name", F.when(F.col("patterns").isNull(), F.raise_error(F.concat(F.lit("no such entry: "), "name")).cast("array<string>")).otherwise(F.array_union("patterns", F.coalesce("_add", F.array()))).alias("patterns"))


# Fixed patterns: terms that a sentence defines, and (long form, alias) pairs.
DEFINED = r"(?:^|\s)(?:\d+\.\s*)?([A-Za-z0-9][^.;:\n]{3,120}?)\s+adalah\s+"
ALIASED = r"([A-Za-z0-9][^.;:\n]{4,120})\s+yang\s+selanjutnya\s+disingkat\s+([A-Z0-9][A-Z0-9./-]{1,20})"


def defined_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(DEFINED), F.lit(1)), normalize_phrase)


def alias_pairs(text: Column) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(ALIASED), F.lit(1)).alias("long"), F.regexp_extract_all(text, F.lit(ALIASED), F.lit(2)).alias("alias"))


def title_phrases(title: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_space(title), r"(?i)\s+(?:tentang|perihal)\s+|\s+[-–—]\s+"), normalize_phrase), lambda x: x != "")
