"""Scores: BM25, multiplicative boosts, titles, plan weights. Numbers under `fixed values` are defaults of parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import share_run

# Fixed values.
BM25_K1, BM25_B = 1.4, 0.75
ROLE_BOOST = {"primary_regulation": 1.45, "attachment": 1.2, "operational_requirement": 1.1, "secondary_faq": 0.75, "secondary_summary": 0.65}
PLAN_ROLE = {"primary_regulation": 1.60, "attachment": 1.05, "operational_requirement": 0.72, "secondary_faq": 0.58, "secondary_summary": 0.50}
LIFECYCLE = {"active": 1.05, "amended": 1.00, "repealed": 0.60, "partially_repealed": 0.72, "superseded": 0.60, "unknown": 1.00}
REASON = {"title": 1.40, "topic": 1.25, "intent": 1.08, "predicate": 1.80, "legal_alias": 1.65, "entity": 1.03}
REASON_DEFAULT = 0.90
MAX_CANDIDATE_TERMS, MIN_MATCH, MIN_MATCH_FROM_TERMS = 6, 2, 3
TITLE_MIN_SCORE = 65.0


def lookup(c: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n_docs: Column, doc_len: Column, avg_len: Column, qf: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """A term's part of a document's score; summed over the query's terms."""
    return idf(n_docs, df) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * doc_len / avg_len)) * qf


def all_in(haystack: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(haystack, t))


def phrase_boost(query: Column, title: Column, text: Column, phrases: Column, in_title: float = 1.45, in_text: float = 1.15) -> Column:
    """Product over the phrases that the query has; all arguments lower case."""
    return F.aggregate(
        F.filter(phrases, lambda p: F.contains(query, p)), F.lit(1.0), lambda acc, p: acc * F.when(F.contains(title, p), in_title).when(F.contains(text, p), in_text).otherwise(1.0)
    )


def lexical_boost(query: Column, terms: Column, title: Column, title_terms: Column, text: Column, number: Column, role: Column, phrases: Column | None = None) -> Column:
    """Whole query found, or all of its (up to six) longer terms; shared title terms; exact phrases; role of the file."""
    haystack = F.concat_ws(" ", title, text, number)
    longer = F.filter(terms, lambda t: F.length(t) >= 3)
    found = F.when(F.contains(haystack, query), 1.35).when((F.size(longer) <= 6) & all_in(haystack, longer), 1.15).otherwise(1.0)
    hits = 1 + F.least(F.lit(0.50), 0.08 * F.size(F.array_intersect(terms, title_terms)))
    exact = phrase_boost(query, title, text, phrases) if phrases is not None else F.lit(1.0)
    return found * hits * exact * lookup(role, ROLE_BOOST)


def issuer_boost(issuer: Column, terms: Column, factor: float = 1.08) -> Column:
    bi = (issuer == "BI") & F.arrays_overlap(terms, F.array(*map(F.lit, ("bi", "bank", "indonesia"))))
    return F.when(bi | ((issuer == "OJK") & F.array_contains(terms, "ojk")), factor).otherwise(1.0)


def title_score_of(shared: Column, query_size: Column, title_size: Column, bonus: Column, run: Column) -> Column:
    """From the numbers of distinct tokens, the bonus of the strings, and the longest shared run (3, 4 or more; null for less):
    coverage both ways; a run of n tokens gives 12 n from n = 3 on, 48 at most; short titles pay against long queries."""
    coverage = shared / F.greatest(F.lit(1), query_size)
    score = coverage * 60.0 + shared / F.greatest(F.lit(1), title_size) * 35.0 + shared * 4.0 + bonus + F.when(run >= 3, F.least(F.lit(48.0), run * 12.0)).otherwise(0.0)
    short = (title_size <= 2) & (query_size >= 4) & (coverage < 0.75)
    return F.when(shared == 0, 0.0).otherwise(score * F.when(short, 0.55).otherwise(1.0))


def title_bonus(query: Column, query_terms: Column, title: Column, title_terms: Column, all_shared: Column) -> Column:
    """For equal or contained strings, or all tokens shared; and for the tokens in order."""
    same = F.when(query == title, 80.0).when(F.contains(title, query) | F.contains(query, title), 45.0).when(all_shared, 35.0).otherwise(0.0)
    return same + F.when(F.contains(F.array_join(title_terms, " "), F.array_join(query_terms, " ")), 35.0).otherwise(0.0)


def may_contain(shared: Column, query_size: Column, title_size: Column, slashes: Column) -> Column:
    """Whether a bonus is possible: a string that contains the other shares all of its tokens but the first and last, unless slashes join tokens."""
    return slashes | (shared >= query_size - 2) | (shared >= title_size - 2)


def title_score(query: Column, query_terms: Column, title: Column, title_terms: Column, with_runs: bool = True) -> Column:
    """title_score_of() and title_bonus() of one pair. query and title are space-normalised and lower case; the terms are their tokens."""
    q, t = F.array_distinct(query_terms), F.array_distinct(title_terms)
    shared = F.size(F.array_intersect(q, t))
    run = F.when(share_run(query_terms, title_terms, 4), 4).when(share_run(query_terms, title_terms, 3), 3) if with_runs else F.lit(None).cast("int")
    return title_score_of(shared, F.size(q), F.size(t), title_bonus(query, query_terms, title, title_terms, shared == F.size(q)), run)


def rank_score(rank: Column) -> Column:
    """rank from 0."""
    return 100.0 / (rank + 5)


def reason_boost(reason: Column) -> Column:
    out = F.lit(REASON_DEFAULT)
    for prefix, v in REASON.items():
        out = F.when(reason.startswith(prefix), v).otherwise(out)
    return out


def order_decay(search_rank: Column) -> Column:
    """Later searches of a plan count less; search_rank from 0."""
    return 1.0 / (1.0 + 0.10 * search_rank)


def overlap_boost(title_overlap: Column, search_overlap: Column) -> Column:
    return 1 + F.least(F.lit(0.60), title_overlap * 0.10 + search_overlap * 0.04)


def subject_multiplier(query: Column, text: Column, subjects: Sequence[str], leading: int = 180) -> Column:
    """A clause that begins with the subject the query names counts more, one that names it later less."""
    import re

    asked, early, late = F.lit(False), F.lit(False), F.lit(False)
    for s in subjects:
        word = rf"(?U)(?<!\w){re.escape(s.lower())}(?!\w)"
        in_query = F.lower(query).rlike(word)
        asked = asked | in_query
        early = early | (in_query & F.substring(F.lower(text), 1, leading).rlike(word))
        late = late | (in_query & F.lower(text).rlike(word))
    return F.when(early, 2.25).when(late, 0.65).otherwise(1.0)


def sector_factor(query: Column, title: Column, first: Sequence[str], second: Sequence[str], mismatch: float = 0.55, absent: float = 0.70) -> Column:
    """Query of the first sector and a title of the second alone: mismatch; the other way round: absent."""

    def any_of(c: Column, terms: Sequence[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(F.lower(c), F.lit(t))
        return out

    q1, q2, t1, t2 = any_of(query, first), any_of(query, second), any_of(title, first), any_of(title, second)
    return F.when(q1 & ~q2 & t2 & ~t1, mismatch).when(q2 & ~q1 & t1 & ~t2, absent).otherwise(1.0)


def aggregate_multiplier(query: Column, is_aggregate: Column) -> Column:
    """Bounded lists answer compound questions (x2) and list requests (x2.5) better than single leaves."""
    q = F.lower(query)
    listed = F.lit(False)
    for t in ("apa saja", "sebutkan", "daftar", "rincian"):
        listed = listed | F.contains(q, F.lit(t))
    compound = F.when(is_aggregate & F.contains(q, F.lit(" dan ")), 2.0).otherwise(1.0)
    return compound * F.when(is_aggregate & listed, 2.5).otherwise(1.0)


def list_multiplier(reason: Column, is_aggregate: Column, unit_type: Column, factor: float = 5.0) -> Column:
    """A search for a list finds the list of a governing ayat: that counts five times."""
    return F.when(reason.startswith("direct_enumeration") & is_aggregate & (unit_type == "ayat"), factor).otherwise(1.0)


def anchor_multiplier(asked: Column, matches: Column, extra_depth: Column) -> Column:
    """0 where asked anchors don't match; else more for exact depth than for deeper units."""
    deep = F.greatest(F.lit(0.65), 1.25 - 0.25 * extra_depth)
    return F.when(~asked, 1.0).when(~matches, 0.0).when(extra_depth == 0, 1.65).otherwise(deep)


def lexical_support(title_overlap: Column, snippet_overlap: Column, phrases: Column) -> Column:
    return F.least(F.lit(1.0), 0.16 * title_overlap + 0.10 * snippet_overlap + 0.20 * phrases)


def support_score(score: Column, lexical: Column, quality: Column, phrases: Column) -> Column:
    return score * (0.75 + lexical) * quality * (1 + 0.15 * phrases)


def normalized_score(score: Column, over: Column) -> Column:
    return F.when(over > 0, score / over).otherwise(0.0)
