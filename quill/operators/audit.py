"""Audits and samples: provenance, issuers, rates with warnings, spot checks by title, examples by section."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import ISSUER_OF_TYPE
from ..functions.text import normalize_space, runs


MOST_TARGETS = 200


def wanted_files(files: DataFrame, include_enrichment: bool = False, ids: Sequence[str] = (), contains: str | None = None, enrichment: str = "sikepo-ojk") -> DataFrame:
    """Files that exist, without the enrichment source unless asked for; of these ids, or with this in path or title."""
    out = files.where("exists")
    if not include_enrichment:
        out = out.where(F.col("source") != enrichment)
    if ids:
        out = out.where(F.col("file_id").isin(list(ids)))
    if contains:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "path", "title")), F.lit(contains.lower())))
    return out


def missing_fields(*names: str) -> Column:
    """Names of the fields that are null or empty."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull() | F.col(n).cast("string").isin("", "[]"), F.lit(n)) for n in names]))


def issuer_mismatch(kind: Column, issuer: Column) -> Column:
    """The issuer that the instrument named in a kind has, where the row's is another. A kind may say more than the
    instrument ("Peraturan (PBI)"); the first that it contains, in the order of the table, is meant. A missing issuer is
    another."""
    known = F.when(F.lit(False), "")
    for k, v in ISSUER_OF_TYPE.items():
        known = known.when(F.contains(F.upper(kind), F.lit(k)), v)
    return F.when(known != F.coalesce(issuer, F.lit("")), known)


def rates(rows: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Share of the rows that meet each condition."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), digits).alias(n) for n, c in conditions.items()])


def warnings(measured: DataFrame, least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None) -> DataFrame:
    """Adds warnings: rates under their least or over their most."""
    low = [F.when(F.col(n) < v, F.lit(f"{n}_below_{v}")) for n, v in (least or {}).items()]
    high = [F.when(F.col(n) > v, F.lit(f"{n}_above_{v}")) for n, v in (most or {}).items()]
    return measured.withColumn("warnings", F.array_compact(F.array(*low, *high)))


def by_title(rows: DataFrame, targets: DataFrame, title: str = "title") -> DataFrame:
    """rows of each target (target, patterns, issuer): any pattern in the title, issuer equal if the target has one.
    Targets are a report's list, of MOST_TARGETS at most: they become one expression, and rows are read once, without a join."""
    listed = targets.select("target", "patterns", "issuer").limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError("too many targets for one report; give them in blocks")
    low = F.lower(F.col(title))

    def hit(t) -> Column:
        any_of = F.lit(False)
        for p in t["patterns"]:
            any_of = any_of | F.contains(low, F.lit(p.lower()))
        return any_of if t["issuer"] is None else any_of & (F.col("issuer") == t["issuer"])

    return rows.withColumn("target", F.explode(F.array_compact(F.array(*[F.when(hit(t), F.lit(t["target"])) for t in listed], F.lit(None).cast("string")))))


def examples(rows: DataFrame, section: str, preferred: Sequence[str], limit: int, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """`limit` rows a group: the first of each preferred section in turn, then the first of the rest."""
    own = F.row_number().over(Window.partitionBy(*by, section).orderBy(*order))
    turn = F.array_position(F.array(*map(F.lit, preferred)), F.col(section))
    first = rows.withColumn("_turn", F.when((own == 1) & (turn > 0), turn).otherwise(len(preferred) + 1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_turn", *order))
    return first.withColumn("place", place).where(F.col("place") <= limit).drop("_turn")


def legal_order(ayat: Column, huruf: Column, angka: Column) -> Column:
    """Sort key of siblings: number of the ayat, place of the letter, number of the angka; 0 where there is none."""

    def number(c: Column) -> Column:
        return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d+", 0).try_cast("int"), F.lit(0))

    letter = F.regexp_extract(F.lower(F.regexp_replace(F.coalesce(huruf, F.lit("")), "(?i)huruf", "")), "[a-z]", 0)
    return F.struct(number(ayat).alias("ayat"), F.when(letter != "", F.ascii(letter) - 96).otherwise(0).alias("huruf"), number(angka).alias("angka"))


def phrase_anchored(phrase: Column, query: Column) -> Column:
    """Token arrays: the phrase's initials are a word of the query, or each of its words contains, or is in, one of the query's."""
    initials = F.array_join(F.transform(phrase, lambda p: F.substring(p, 1, 1)), "")
    each = F.forall(phrase, lambda p: F.exists(query, lambda q: F.contains(q, p) | F.contains(p, q)))
    return (F.size(phrase) > 0) & (F.array_contains(query, initials) | each)


def shared_acronyms(query: Column, title: Column, least: int = 3, most: int = 4, limit: int = 4) -> Column:
    """Initials of the runs of `least` to `most` tokens that query and title share, longest runs first, at most `limit`."""

    shared = F.flatten(F.array(*[F.array_intersect(runs(title, n), runs(query, n)) for n in range(most, least - 1, -1)]))
    letters = F.transform(shared, lambda r: F.regexp_replace(F.array_join(F.transform(F.split(r, " "), lambda w: F.substring(w, 1, 1)), ""), "[^a-z]", ""))
    return F.slice(F.array_distinct(F.filter(letters, lambda a: F.length(a) >= least)), 1, limit)


def title_scope(titles: DataFrame, ratio: float = 0.75, similarity: float = 0.70, governing: Sequence[str] = ("pojk", "peraturan ojk", "pbi", "peraturan bank indonesia")) -> DataFrame:
    """titles: search_id, file_id, title_score, regulation_type, terms. Near the best score; governing instruments alone if there are
    any, and with them governing titles of all scores that share enough words with the best one's."""
    w = Window.partitionBy("search_id")
    kind = F.lower(normalize_space(F.col("regulation_type"))).isin(*governing)
    near = F.col("title_score") >= ratio * F.max("title_score").over(w)
    marked = titles.withColumns({"_governs": kind, "_near": near})
    lead = marked.where("_near AND _governs").groupBy("search_id").agg(F.min_by("terms", F.struct(-F.round("title_score", 6), F.col("file_id"))).alias("_lead"))
    out = marked.join(lead, "search_id", "left")
    alike = F.size(F.array_intersect("terms", "_lead")) / F.greatest(F.lit(1), F.size(F.array_union("terms", "_lead"))) >= similarity
    keep = F.when(F.col("_lead").isNull(), F.col("_near")).otherwise(F.col("_governs") & (F.col("_near") | alike))
    return out.where(keep).select("search_id", "file_id", "title_score")
