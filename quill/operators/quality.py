"""Audits of what was built and answered: nine rules over units, nineteen checks of an answer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import complete
from .audit import issuer_mismatch
from .catalog import rule_audit

# Patterns and bounds of the rules; weights of the checks, which are all hard but one.
DANGLING = r"(?i)\b(?:(?:pada|dalam|di)\s+)?(?:ayat|Pasal|huruf)\s*$"
URL = r"(?i)https?://(?:www\.)?jdih\.ojk\.go\.id/?"
EXPLAINS = r"(?i)(?:^\s*(?:Pasal\s+\d+[A-Z]?\s+)?Cukup\s+jelas\.?\s*$|\bAgar\s+setiap\s+orang\s+mengetahuinya\b)"
ADMITTED = ("atomic_leaf", "enumeration_aggregate")
WEIGHTS = {
    "status_matches_expected": 0.14,
    "not_found_has_no_citations": 0.08,
    "has_required_terms": 0.12,
    "has_uncertainty_terms": 0.06,
    "has_required_citation_terms": 0.08,
    "has_min_citations": 0.07,
    "source_lines_match_citation_count": 0.05,
    "has_required_issuers": 0.06,
    "primary_sources_first_enough": 0.04,
    "not_too_long": 0.03,
    "no_noisy_fragments": 0.03,
    "no_truncated_bullets": 0.02,
    "partial_has_uncertainty": 0.01,
    "finding_limit_respected": 0.04,
    "findings_are_complete_and_supported": 0.08,
    "citation_ids_are_unique": 0.03,
    "citation_targets_are_valid": 0.07,
    "no_orphan_citations": 0.04,
    "not_found_has_no_findings": 0.01,
}
SOFT, ACCEPTED, PRIMARY_RATE, MOST_FINDINGS, LONGEST = ("primary_sources_first_enough",), 0.86, 0.75, 3, 5000
NOISY = (
    r"!\[[^\]]*\]\([^)]+\)",
    r"\|---",
    "DENGAN RAHMAT TUHAN YANG MAHA ESA",
    r"\bMenimbang\s*:",
    "Cuplikan lanjutan dari evidence",
    "Lembaran Negara",
    "Tambahan Lembaran Negara",
    "Sehubungan dengan amanat",
)


def _absent(name: str, kind: str) -> Column:
    c = F.col(name)
    return c.isNull() | (F.size(c) == 0) if kind.startswith(("array", "map")) else c.isNull() | (c.cast("string") == "")


def unit_rules(rows: DataFrame) -> dict[str, Column]:
    """The rules over rows with admitted and of_corpus (booleans), unit_type, document_part, display_text, retrieval_text, page_start,
    page_end, legal_path, regulation_type, issuer, readable, searchable_primary, node_id, legal_unit, source_block_ids,
    anchors, source_spans. A rule is true where a row breaks it."""
    kinds = dict(rows.dtypes)
    text, part, unit = F.coalesce("display_text", F.lit("")), F.col("document_part"), F.col("unit_type")
    normative = F.coalesce(part == "normative", F.lit(True))
    missing = F.lit(False)
    for name in ("node_id", "legal_unit", "source_block_ids", "anchors", "display_text", "retrieval_text", "document_part", "source_spans"):
        missing = missing | _absent(name, kinds[name])
    size, pages = F.length(text), F.coalesce(F.col("page_end") - F.col("page_start"), F.lit(0))
    rules = {
        "missing_legal_unit_provenance": missing,
        "dangling_legal_reference": F.col("admitted") & unit.isin("pasal", "ayat", "huruf", "angka") & text.rlike(DANGLING),
        "oversized_normative_pasal": F.col("admitted") & (unit == "pasal") & normative & (((pages >= 2) & (size > 1500)) | (size > 3000)),
        "url_contamination": F.concat_ws(" ", "display_text", "retrieval_text").rlike(URL),
        "empty_legal_path": F.col("admitted") & _absent("legal_path", kinds["legal_path"]),
        "issuer_instrument_mismatch": issuer_mismatch(F.upper("regulation_type"), F.coalesce("issuer", F.lit(""))).isNotNull(),
        "suppressed_duplicate_leakage": F.col("of_corpus") & ~F.coalesce("searchable_primary", F.lit(True)),
        "unreadable_table_citation_admission": F.col("admitted") & (unit == "table") & ~F.coalesce("readable", F.lit(False)),
        "document_part_contamination": F.col("admitted") & (F.coalesce(part == "promulgation", F.lit(False)) | (normative & text.rlike(EXPLAINS))),
    }
    inside = ~F.col("of_corpus") | ~F.col("in_blocks")  # what units are is judged once: a unit of the corpus that is among the blocks was judged there
    always = ("missing_legal_unit_provenance", "suppressed_duplicate_leakage")
    return {name: F.coalesce(c if name in always else c & inside, F.lit(False)) for name, c in rules.items()}


def audit_units(blocks: DataFrame, corpus: DataFrame, keys: tuple[str, str], examples: int = 5) -> DataFrame:
    """(rule, violations, examples) over the blocks (with admission) and the corpus made of them; a rule that none breaks has no row."""
    both = blocks.withColumns({"of_corpus": F.lit(False), "in_blocks": F.lit(True), "admitted": F.coalesce(F.col("admission").isin(*ADMITTED), F.lit(False))})
    seen = blocks.select(*keys).distinct().withColumn("in_blocks", F.lit(True))
    of_corpus = corpus.join(seen, list(keys), "left").withColumns({"of_corpus": F.lit(True), "in_blocks": F.coalesce("in_blocks", F.lit(False)), "admitted": F.lit(True)})
    rows = both.unionByName(of_corpus, allowMissingColumns=True)
    return rule_audit(rows, unit_rules(rows), list(keys), examples)


def _all_said(text: Column, terms: Column) -> Column:
    return F.forall(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(F.lower(text), F.lower(t)))


def answer_checks(answers: DataFrame) -> DataFrame:
    """answers with a boolean for each check of WEIGHTS. Columns: expected and status, answer, summary, findings (text, status,
    citation_ids), citations (id, file_id, issuer, text, source_block_ids, page_start, page_end), documents (issuer,
    source_priority), citation_count, required_terms, uncertainty_terms, citation_terms, required_issuers, min_citations, max_chars."""
    none = F.col("expected") == "not_found"
    ids = F.transform("citations", lambda c: c["id"])
    used = F.array_distinct(F.flatten(F.transform("findings", lambda f: f["citation_ids"])))
    shown = F.concat_ws("\n", "answer", "summary", F.array_join(F.transform("findings", lambda f: f["text"]), "\n"))
    issuers = F.array_union(F.transform("documents", lambda d: d["issuer"]), F.transform("citations", lambda c: c["issuer"]))
    primary = F.size(F.filter("documents", lambda d: d["source_priority"] == "primary")) / F.greatest(F.lit(1), F.size("citations"))
    supported = F.forall("findings", lambda f: complete(f["text"]) & (f["status"] == "supported") & (F.size(f["citation_ids"]) > 0) & (F.size(F.array_except(f["citation_ids"], ids)) == 0))
    target = F.forall("citations", lambda c: (F.coalesce(c["file_id"], F.lit("")) != "") & (F.size(c["source_block_ids"]) > 0) & (c["page_start"] > 0) & (F.coalesce(c["page_end"], c["page_start"]) >= c["page_start"]))
    noisy = F.lit(False)
    for p in NOISY:
        noisy = noisy | F.col("answer").rlike(f"(?i){p}")
    found = F.size("findings") > 0
    checks = {
        "status_matches_expected": F.when(none, F.col("status") == "not_found").otherwise(F.col("status").isin("answerable", "partial")),
        "not_found_has_no_citations": ~(none & (F.col("citation_count") > 0)),
        "has_required_terms": _all_said(shown, F.col("required_terms")),
        "has_uncertainty_terms": _all_said(F.col("answer"), F.col("uncertainty_terms")),
        "has_required_citation_terms": _all_said(F.array_join(F.transform("citations", lambda c: c["text"]), "\n"), F.col("citation_terms")),
        "has_min_citations": F.col("citation_count") >= F.coalesce("min_citations", F.when(none, 0).otherwise(1)),
        "source_lines_match_citation_count": F.size("citations") == F.col("citation_count"),
        "has_required_issuers": F.size(F.array_except("required_issuers", issuers)) == 0,
        "primary_sources_first_enough": none | (primary >= PRIMARY_RATE),
        "not_too_long": F.length("answer") <= F.coalesce("max_chars", F.lit(LONGEST)),
        "no_noisy_fragments": ~noisy,
        "no_truncated_bullets": ~F.col("answer").rlike(r"(?m)^\s*-\s+[a-z]"),
        "partial_has_uncertainty": (F.col("expected") != "partial") | F.contains(F.lower("answer"), F.lit("parsial")),
        "finding_limit_respected": F.size("findings") <= MOST_FINDINGS,
        "findings_are_complete_and_supported": supported & F.when(F.col("status") == "not_found", ~found).otherwise(found),
        "citation_ids_are_unique": (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: F.coalesce(i != "", F.lit(False))),
        "citation_targets_are_valid": target,
        "no_orphan_citations": (F.size(F.array_except(ids, used)) == 0) & (F.size(F.array_except(used, ids)) == 0),
        "not_found_has_no_findings": (F.col("status") != "not_found") | ~found,
    }
    return answers.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in checks.items()})


def answer_quality(answers: DataFrame, weights: Mapping[str, float] = WEIGHTS, accepted: float = ACCEPTED) -> DataFrame:
    """answer_checks() with score (at most 1), failures (of hard checks), warnings and accepted."""
    checked = answer_checks(answers)
    score = F.least(F.lit(1.0), sum((F.when(F.col(k), v).otherwise(0.0) for k, v in weights.items()), F.lit(0.0)))

    def failed(names) -> Column:
        return F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names], F.lit(None).cast("string")))

    out = checked.withColumns({"score": F.round(score, 3), "failures": failed(n for n in weights if n not in SOFT), "warnings": failed(SOFT)})
    return out.withColumn("accepted", (F.round(score, 9) >= accepted) & (F.size("failures") == 0))
