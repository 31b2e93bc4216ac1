"""Text: normalisation, tokens, token-set overlap, snippets, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: a token is a run of ASCII letters and digits; slash-joined parts (numbers of regulations) stay together.
TOKEN = r"[a-zA-Z0-9]+(?:/[a-zA-Z0-9.]+)*"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_space(c: Column) -> Column:
    """Runs of any Unicode white space become one space; null becomes ''."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def short_hash(c: Column) -> Column:
    """First 12 hex digits of SHA-1."""
    return F.substring(F.sha1(c), 1, 12)


def tokens(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case tokens of over one character that aren't stop words, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: F.length(t) > 1)
    return F.filter(kept, lambda t: ~t.isin(list(stopwords))) if stopwords else kept


def unique(array: Column) -> Column:
    """Ordered distinct: first occurrences stay."""
    return F.array_distinct(array)


def overlap_score(query: Column, value: Column) -> Column:
    """Distinct shared tokens plus up to a half for the length of the value; both arguments are token arrays."""
    shared = F.size(F.array_intersect(query, value))
    score = shared + F.least(F.lit(0.5), F.size(value) * 0.03)
    return F.when((F.size(query) == 0) | (F.size(value) == 0), F.lit(0.0)).otherwise(score)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def jaccard_of_sizes(shared: Column, left: Column, right: Column) -> Column:
    """jaccard() from the numbers of shared, left and right distinct tokens."""
    return shared / F.greatest(F.lit(1), left + right - shared)


def contains_pattern(value: Column, pattern: str) -> Column:
    """Case-blind containment; a single word of up to three characters must stand alone."""
    import re

    p = pattern.lower()
    if not p:
        return F.lit(False)
    if len(p) <= 3 and re.fullmatch(r"\w+", p):
        return F.lower(value).rlike(rf"(?U)(?<!\w){re.escape(p)}(?!\w)")
    return F.contains(F.lower(value), F.lit(p))


def contains_term(value: Column, term: str) -> Column:
    """Whole-word, case-blind."""
    import re

    return value.rlike(rf"(?iU)(?<!\w){re.escape(term)}(?!\w)")


def longest_run(left: Column, right: Column) -> Column:
    """Length of the longest token sequence that both arrays have, by the running diagonal of each token of the left."""
    rows = F.aggregate(
        left,
        F.struct(F.transform(right, lambda _: F.lit(0)).alias("row"), F.lit(0).alias("best")),
        lambda acc, token: _next_row(acc, token, right),
    )
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0).otherwise(rows["best"])


def runs(array: Column, n: int) -> Column:
    """The runs of n tokens, joined by spaces."""
    starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " "))


def share_run(left: Column, right: Column, n: int) -> Column:
    """Whether both arrays have a run of n tokens in common."""
    return F.arrays_overlap(runs(left, n), runs(right, n))


def _next_row(acc: Column, token: Column, right: Column) -> Column:
    before = F.slice(F.concat(F.array(F.lit(0)), acc["row"]), F.lit(1), F.size(right))
    row = F.zip_with(right, before, lambda r, d: F.when(r == token, d + 1).otherwise(0))
    return F.struct(row.alias("row"), F.greatest(acc["best"], F.array_max(row)).alias("best"))


def snippet(text: Column, terms: Column, length: int = 420, before: int = 120) -> Column:
    """`length` characters from `before` characters ahead of the first term, with ellipses where something is left out."""
    flat = normalize_space(text)
    low = F.lower(flat)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda p: p >= 0))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(before)) - before)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(flat, start + 1, F.lit(length)), F.when(start + length < F.length(flat), "...").otherwise(""))


def truncate_at_space(text: Column, limit: int = 360) -> Column:
    flat = normalize_space(text)
    head = F.regexp_extract(F.substring(flat, 1, limit + 1), r"^(.*)\s", 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.when(head == "", F.substring(flat, 1, limit)).otherwise(head)), F.lit("…")))


def composite_key(*parts: Column) -> Column:
    """Parts joined by bars, nulls as ''."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def embedding_text(*parts: Column, limit: int = 6000) -> Column:
    return F.substring(normalize_space(F.concat_ws(" ", *parts)), 1, limit)


def with_prefix(text: Column, prefix: str) -> Column:
    """The model's role prefix, unless it is there."""
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def first_value(*values: Column) -> Column:
    """First that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
