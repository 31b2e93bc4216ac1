"""The engine: corpus, index, planner and gates behind one object. Every method takes and returns DataFrames of many
questions; a single question is a table of one row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import citation, claims, legal, scoring
from .functions.text import overlap_score, snippet, tokens
from .operators import evidence as ed
from .operators import index as ix
from .operators import search as se
from .plans import execute as ex
from .plans.planner import Plan, Planner, searches_table

FIELDS = ("title", "number", "regulation_type", "pasal", "ayat", "huruf", "angka", "text", "issuer", "role", "file_id", "block_id")


@dataclass
class Engine:
    """units: doc_id and the FIELDS (strings; null where a unit has none), page_start. A term of the title counts three
    times, of the number twice."""

    spark: SparkSession
    units: DataFrame
    lexicon: Mapping = field(default_factory=dict)
    stopwords: tuple[str, ...] = ()
    max_searches: int = 8
    limit: int = 12
    per_document: int = 3

    def __post_init__(self):
        missing = {"doc_id", "page_start", *FIELDS} - set(self.units.columns)
        if missing:
            raise ValueError(f"units lack {sorted(missing)}")
        weights = {"title": 3, "number": 2, "regulation_type": 1, "pasal": 1, "ayat": 1, "text": 1}
        self.index = ix.build(self.units, weights=weights, stopwords=self.stopwords, keep=True)
        self.planner = Planner(self.lexicon, self.stopwords)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Frees what the session keeps of the index."""
        self.index.close()

    def plans(self, questions: Mapping[int, str] | Iterable[str]) -> dict[int, Plan]:
        items = questions.items() if isinstance(questions, Mapping) else enumerate(questions)
        return {k: self.planner.plan(q, self.max_searches) for k, q in items}

    def search(self, questions: Mapping[int, str], limit: int | None = None) -> DataFrame:
        """Plain search, without a plan: (search_id, doc_id, score, rank)."""
        s = self.spark.createDataFrame(list(questions.items()), "search_id long, query string")
        hits = se.boosted(se.bm25(self.index, s, stopwords=self.stopwords), self.units, s, self.stopwords)
        return se.top(hits, "score", limit or self.limit).select("search_id", "doc_id", "score", "rank")

    def titles(self, questions: Mapping[int, str], limit: int | None = None) -> DataFrame:
        """Documents by their titles: the best unit of each stands for it."""
        rank = ix.representative_rank(F.lit(None).cast("string"), self._quality(), F.col("page_start"), F.lit(None).cast("string"), F.col("text"))
        best = ix.representatives(self.units, ["file_id"], rank, "doc_id")
        s = self.spark.createDataFrame(list(questions.items()), "search_id long, query string")
        return se.title_search(best, s, self.stopwords, limit=limit or self.limit, key="file_id")

    def _quality(self):
        return citation.citation_quality(F.col("title"), F.col("page_start"), F.col("pasal"), F.col("ayat"), F.col("huruf"), F.lit(None).cast("string"))

    def _questions(self, plans: Mapping[int, Plan]) -> DataFrame:
        rows = [
            (k, p.raw_query, p.ambiguity, [i for i in p.issuers if i], bool(p.topics or [e for e in p.entities if e != "bank"]), *(p.legal_constraints.get(c) for c in ("pasal", "ayat", "huruf")))
            for k, p in plans.items()
        ]
        return self.spark.createDataFrame(rows, "query_id long, raw_query string, ambiguity string, issuers array<string>, has_topic boolean, asked_pasal string, asked_ayat string, asked_huruf string")

    def planned_search(self, plans: Mapping[int, Plan]) -> DataFrame:
        q = self._questions(plans)
        return ex.execute(self.index, searches_table(self.spark, plans), q.drop("issuers", "has_topic", "ambiguity"), self.limit, self.stopwords)

    def evidence(self, plans: Mapping[int, Plan]) -> DataFrame:
        """The plan's results as evidence: support, flags, alignment with the question; rejected items are kept and marked."""
        q = self._questions(plans).withColumn("query_terms", tokens(F.col("raw_query"), self.stopwords))
        found = self.planned_search(plans).join(self.units, "doc_id").join(q, "query_id")
        title_terms, text_terms = tokens(F.col("title"), self.stopwords), tokens(F.substring("text", 1, 1000), self.stopwords)
        read = found.withColumns({"title_terms": title_terms, "text_terms": text_terms, "flags": citation.issue_flags(F.col("title"), F.col("page_start"), F.col("text"))})
        overlaps = read.withColumns({"title_overlap": overlap_score(F.col("query_terms"), F.col("title_terms")), "snippet_overlap": overlap_score(F.col("query_terms"), F.col("text_terms"))})
        lexical = overlaps.withColumn("lexical_support", scoring.lexical_support(F.col("title_overlap"), F.col("snippet_overlap"), F.lit(0)))
        tables = F.lower("raw_query").rlike(claims.TABLE_WORDS)
        compound = legal.wants_compound(F.col("raw_query"))
        aligned = legal.alignment(F.col("raw_query"), F.col("title"), F.col("text"), legal.alignment_ratio(F.col("raw_query"), F.col("ambiguity")), F.col("ambiguity").isNotNull() | compound, compound, self.stopwords)
        return lexical.withColumns({
            "support_score": scoring.support_score(F.col("score"), F.col("lexical_support"), citation.quality_multiplier(F.col("flags"), tables), F.lit(0)),
            "alignment": aligned, "citation_quality": self._quality(), "is_primary": ~F.col("role").isin(*se.SECONDARY), "snippet": snippet(F.col("text"), F.col("query_terms")),
            "citation": citation.citation_text(F.col("title"), F.col("page_start"), F.col("pasal"), F.col("ayat"), F.col("huruf")),
        })

    def confidence(self, evidence: DataFrame) -> DataFrame:
        """(query_id, score, label, must_say_not_found) of questions with aligned evidence."""
        seen = F.array_union(F.col("title_terms"), F.col("text_terms"))
        asked = F.greatest(F.lit(1), F.size(F.array_distinct("query_terms")))
        items = evidence.where("alignment.accepted").select(
            "query_id", "support_score", "doc_id", "is_primary", F.col("page_start").isNotNull().alias("has_page"), F.col("pasal").isNotNull().alias("has_article"), "lexical_support", F.lit(0).alias("phrases"),
            (F.size(F.array_intersect("query_terms", seen)) / asked).alias("coverage"), ((F.size("issuers") == 0) | F.array_contains("issuers", F.col("issuer"))).alias("issuer_hit"),
            F.col("ambiguity").isNotNull().alias("ambiguous"), F.col("asked_pasal").isNotNull().alias("exact_support"), "has_topic",
        )
        return ed.confidence(items, order=[F.round("support_score", 6).desc(), F.col("doc_id")])

    def answer(self, plans: Mapping[int, Plan]) -> DataFrame:
        """(query_id, status, summary, findings): cited claims, or not_found where nothing supports one."""
        e = self.evidence(plans)
        sure = self.confidence(e)
        claim = claims.claim_text(F.col("text"), F.lit(False))
        section = F.when(F.col("ayat").isNotNull(), "ayat").when(F.col("pasal").isNotNull(), "pasal").otherwise("text")
        items = e.withColumn("claim", claim).select(
            "query_id", claims.rank(F.col("raw_query"), F.col("query_terms"), F.col("claim"), tokens(F.col("claim"), self.stopwords), F.col("support_score"), section, F.col("citation_quality"), F.col("regulation_type"), F.col("title"), F.array().cast("array<string>")).alias("rank"),
            (F.col("alignment.accepted") & claims.usable(F.col("raw_query"), F.col("claim"), section, F.col("flags")) & claims.complete(F.col("claim"))).alias("usable"),
            "issuer", F.array_contains("issuers", F.col("issuer")).alias("required"), F.col("title").alias("document"), "citation", "title_overlap", F.col("block_id").alias("block"), "claim",
        )
        asked = self._questions(plans).select("query_id", "ambiguity").join(sure, "query_id", "left").fillna({"label": "not_found", "must_say_not_found": True})
        return ed.answers(ed.select_findings(items, per_document=self.per_document), asked)

    def trace(self, plans: Mapping[int, Plan]) -> DataFrame:
        return ed.trace(self.evidence(plans))

    def document(self, file_id: str) -> DataFrame:
        """A document's units in reading order; its first is where.limit(1)."""
        return self.units.where(F.col("file_id") == file_id).orderBy("page_start", "doc_id")

    def block(self, file_id: str, block_id: str) -> DataFrame:
        return self.units.where((F.col("file_id") == file_id) & (F.col("block_id") == block_id)).limit(1)
