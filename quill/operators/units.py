"""Structural units by windows: parents, paths, ordinals, siblings, list aggregates, spans, aliases.

rows: one per line or unit of a document, with a level (1 is outermost) where a unit begins. All windows are partitioned
by document (and part), so the work spreads over documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space


def running_part(rows: DataFrame, boundary: Column, doc: Sequence[str], order: str) -> DataFrame:
    """Adds part: the last boundary's name at or before the row, else 'normative'."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.coalesce(F.last(boundary, ignorenulls=True).over(w), F.lit("normative")))


def parents(rows: DataFrame, doc: Sequence[str], pos: str, level: str, levels: int) -> DataFrame:
    """Adds parent_pos: the last row before with a lower level that no row between closes. The last position of each level
    is carried forward, and the greatest of those of lower levels is the parent."""
    w = Window.partitionBy(*doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.col(pos)), ignorenulls=True).over(w) for k in range(1, levels + 1)}
    marked = rows.withColumns({f"_l{k}": v for k, v in last.items()})
    parent = F.lit(None).cast("int")
    for k in range(2, levels + 1):
        lower = [F.coalesce(F.col(f"_l{j}"), F.lit(0)) for j in range(1, k)]
        best = F.greatest(*lower) if len(lower) > 1 else lower[0]
        parent = F.when(F.col(level) == k, F.nullif(best, F.lit(0))).otherwise(parent)
    return marked.withColumn("parent_pos", parent.cast("int")).drop(*[f"_l{k}" for k in last])


def paths(rows: DataFrame, doc: Sequence[str], pos: str, level: str, levels: int) -> DataFrame:
    """Adds path: positions of the open units from the outermost to the row itself. A level's last unit is open unless one
    of a lower level came after it."""
    w = Window.partitionBy(*doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({f"_l{k}": F.coalesce(F.last(F.when(F.col(level) == k, F.col(pos)), ignorenulls=True).over(w), F.lit(0)) for k in range(1, levels + 1)})
    live = []
    for k in range(1, levels + 1):
        over = [F.col(f"_l{j}") for j in range(1, k)]
        closed = (F.greatest(*over) if len(over) > 1 else over[0]) > F.col(f"_l{k}") if over else F.lit(False)
        live.append(F.when((F.col(f"_l{k}") > 0) & ~closed & (F.lit(k) <= F.col(level)), F.col(f"_l{k}")))
    return marked.withColumn("path", F.array_compact(F.array(*live))).drop(*[f"_l{k}" for k in range(1, levels + 1)])


def siblings(rows: DataFrame, doc: Sequence[str], pos: str, parent: str = "parent_pos") -> DataFrame:
    """Adds previous_pos (the sibling before) and ordinal (place among siblings, from 1)."""
    w = Window.partitionBy(*doc, parent).orderBy(pos)
    return rows.withColumn("previous_pos", F.lag(pos).over(w)).withColumn("ordinal", F.row_number().over(w))


def leaves(rows: DataFrame, doc: Sequence[str], pos: str, parent: str = "parent_pos") -> DataFrame:
    """Rows that are nobody's parent."""
    taken = rows.where(F.col(parent).isNotNull()).select(*doc, F.col(parent).alias(pos)).distinct()
    return rows.join(taken, [*doc, pos], "left_anti")


def list_aggregates(rows: DataFrame, doc: Sequence[str], pos: str, text: str, parent: str = "parent_pos", least: int = 2, most: int = 12, longest: int = 2400) -> DataFrame:
    """A parent with its children's texts in order, where it has from `least` to `most` children and the whole is short
    enough. Children are counted before their texts are gathered, so no long list is ever collected."""
    children = rows.where(F.col(parent).isNotNull()).select(*doc, F.col(parent).alias("_p"), F.col(pos).alias("_c"), F.col(text).alias("_t"))
    counts = children.groupBy(*doc, "_p").agg(F.count(F.lit(1)).alias("children"), F.sum(F.length("_t") + 1).alias("_n"))
    few = counts.where(F.col("children").between(least, most) & (F.col("_n") <= longest))
    lists = children.join(few, [*doc, "_p"]).groupBy(*doc, "_p", "children").agg(F.array_sort(F.collect_list(F.struct("_c", "_t"))).alias("_list"))
    own = rows.select(*doc, F.col(pos).alias("_p"), F.col(text).alias("_own")).where(normalize_space(F.col("_own")) != "")
    joined = own.join(lists, [*doc, "_p"]).withColumn("text", F.concat_ws("\n", F.col("_own"), F.array_join(F.transform("_list", lambda x: x["_t"]), "\n")))
    return joined.where(F.length("text") <= longest).select(*doc, F.col("_p").alias(pos), "children", "text")


def page_spans(lines: DataFrame, unit: Sequence[str], page: str, line: str, text: str) -> DataFrame:
    """One span for each page of a unit: first and last line, text, and the page of the span it continues."""
    spans = lines.groupBy(*unit, page).agg(
        F.min(line).alias("line_start"), F.max(line).alias("line_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text]), "\n").alias("text")
    )
    return spans.withColumn("continues_page", F.lag(page).over(Window.partitionBy(*unit).orderBy(page)))


# Fixed pattern: a long form, the phrase that introduces its abbreviation, the abbreviation.
ALIAS = r"([A-Z][^.;:\n]{2,180}?)\s+(?i:yang\s+selanjutnya\s+(?:disingkat|disebut)(?:\s+sebagai)?)\s+([A-Z][A-Z0-9]{1,11})\b"


def acronyms(rows: DataFrame, doc: Sequence[str], text: str, pattern: str = ALIAS) -> DataFrame:
    """(doc, alias, long_form) of abbreviations that a document defines in one way only; long forms have 2 to 16 words."""
    found = rows.select(*doc, F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("long"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("alias"))).alias("x"))
    long = F.regexp_replace(F.regexp_replace(normalize_space(F.col("x.long")), r"^[ ,;:-]+|[ ,;:-]+$", ""), r"^\d+[.)]\s*", "")
    named = found.select(*doc, F.col("x.alias").alias("alias"), long.alias("long_form")).where(F.size(F.split("long_form", " ")).between(2, 16))
    one = named.groupBy(*doc, "alias").agg(F.min("long_form").alias("long_form"), F.max("long_form").alias("_max"))
    return one.where("long_form = _max").drop("_max")


def with_aliases(units: DataFrame, aliases: DataFrame, doc: Sequence[str], key: Sequence[str], text: str, most: int = 3) -> DataFrame:
    """Adds, to the search text, up to `most` of the document's aliases of which exactly one form occurs."""
    def word(term: str) -> Column:
        return F.expr(rf"{text} RLIKE concat('(?iU)(?<!\\w)\\Q', {term}, '\\E(?!\\w)')")

    hits = units.select(*doc, *[k for k in key if k not in doc], text).join(aliases, list(doc)).where(word("alias") != word("long_form"))
    rank = F.row_number().over(Window.partitionBy(*doc, *[k for k in key if k not in doc]).orderBy("alias"))
    some = hits.withColumn("_n", rank).where(F.col("_n") <= most).groupBy(*doc, *[k for k in key if k not in doc])
    added = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alias", "long_form"))), lambda x: F.concat(x["long_form"], F.lit(" ("), x["alias"], F.lit(")"))), "; ").alias("_added"))
    out = units.join(added, list(dict.fromkeys([*doc, *key])), "left")
    return out.withColumn(text, F.when(F.col("_added").isNull(), F.col(text)).otherwise(F.concat(F.col(text), F.lit(" Istilah terkait: "), F.col("_added"), F.lit(".")))).drop("_added")
