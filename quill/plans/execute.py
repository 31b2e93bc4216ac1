"""Executes the searches of many plans as one set of joins: passage search, title scope, scoring, quotas, siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal, scoring
from ..functions.text import overlap_score, tokens
from ..operators import search as se
from ..operators.index import Index


def keyed(searches: DataFrame) -> DataFrame:
    """Adds search_id, one number for (query_id, search_rank)."""
    return searches.withColumn("search_id", F.col("query_id") * 1000 + F.col("search_rank"))


def title_scope(titles: DataFrame, searches: DataFrame, stopwords: Sequence[str] = (), limit: int = 8) -> DataFrame:
    """(search_id, doc key) of documents whose titles come near the best title of a search: what its passages may be limited to."""
    found = se.title_search(titles, searches, stopwords, limit=limit, key="file_id")
    return se.near_best(found, "title_score").select("search_id", "file_id")


def execute(index: Index, searches: DataFrame, questions: DataFrame, limit: int = 12, stopwords: Sequence[str] = (), scope: DataFrame | None = None, issuers: int = 2) -> DataFrame:
    """searches: the planner's table; questions: query_id, raw_query, and pasal, ayat, huruf if asked for. index.docs: doc_id, file_id, title, text, number,
    issuer, role, pasal, ayat, huruf. Returns (query_id, place, doc_id, score, reason), `limit` rows a question.

    All searches of all questions are scored by one join to the postings; a unit found by several searches keeps its best.
    """
    s = keyed(searches)
    hits = se.bm25(index, s, filters=("issuer", "role"), stopwords=stopwords, scope=scope, limit=max(4 * limit, 16))
    asked_for = s.select("search_id", "query_id", "search_rank", tokens(F.col("query"), stopwords).alias("search_terms"), "reason", "include_secondary")
    asking = questions.withColumn("raw_terms", tokens(F.col("raw_query"), stopwords))
    read = index.docs.withColumn("title_terms", tokens(F.col("title"), stopwords))
    rows = hits.join(asked_for, "search_id").join(read, "doc_id").where(F.col("include_secondary") | ~F.col("role").isin(*se.SECONDARY)).join(asking, "query_id")
    asked = F.struct(*[F.col(f"asked_{c}").alias(c) if f"asked_{c}" in questions.columns else F.lit(None).cast("string").alias(c) for c in ("pasal", "ayat", "huruf")])
    anchored = asked["pasal"].isNotNull() | asked["ayat"].isNotNull() | asked["huruf"].isNotNull()
    deeper = sum(((F.col(c).isNotNull() & asked[c].isNull()).cast("int") for c in ("pasal", "ayat", "huruf")), F.lit(0))
    score = (
        scoring.rank_score(F.col("rank") - 1)
        * scoring.reason_boost(F.col("reason"))
        * scoring.order_decay(F.col("search_rank"))
        * scoring.overlap_boost(overlap_score(F.col("raw_terms"), F.col("title_terms")), overlap_score(F.col("search_terms"), F.col("title_terms")))
        * scoring.lookup(F.col("role"), scoring.PLAN_ROLE)
        * scoring.anchor_multiplier(anchored, legal.path_match(asked, F.col("pasal"), F.col("ayat"), F.col("huruf")), deeper)
    )
    scored = rows.withColumn("score", score).where("score > 0").select("query_id", "doc_id", "title", "issuer", "text", "score", "reason")
    order = [F.round("score", 6).desc(), F.col("doc_id")]
    once = se.dedupe_ranked(scored, [F.col("doc_id")], [*order, F.col("reason")], by=("query_id",))
    plain = se.dedupe_ranked(once, [F.col("title"), F.substring("text", 1, 120)], order, by=("query_id",))
    best = se.quota_top(plain, "issuer", limit, order, by=("query_id",), groups=issuers)
    return best.withColumn("place", F.row_number().over(_by_question(order))).select("query_id", "place", "doc_id", "score", "reason")


def _by_question(order):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


def siblings(seeds: DataFrame, units: DataFrame, most: int = 12) -> DataFrame:
    """seeds: query_id, score and a unit's file_id, pasal, ayat, huruf, angka, raw_query. The units of the parents of each question's best `most` seeds,
    each parent once, at 0.55 of the seed's score and 8 for each overlapping word."""
    from pyspark.sql import Window

    top = seeds.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id"))).where(F.col("_n") <= most)
    parent = F.when(F.col("huruf").isNotNull() | F.col("angka").isNotNull(), F.col("ayat"))
    parents = top.where("pasal IS NOT NULL").select("query_id", "raw_query", "file_id", "pasal", parent.alias("_ayat"), "score", "_n")
    once = parents.groupBy("query_id", "raw_query", "file_id", "pasal", "_ayat").agg(F.max("score").alias("_seed"))
    found = units.join(once, ["file_id", "pasal"]).where(F.col("_ayat").isNull() | (F.col("_ayat") == F.col("ayat")))
    return found.withColumn("score", 0.55 * F.col("_seed") + 8.0 * overlap_score(tokens(F.col("raw_query")), tokens(F.col("text")))).drop("_seed", "_ayat")
