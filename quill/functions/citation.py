"""Citations: quality ladder, labels, priorities, issue flags, admission of units as evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space

# Fixed values.
PATH = ("bab", "section", "point", "subpoint", "item", "bagian", "paragraf", "pasal", "ayat", "huruf", "angka")
PRIMARY_ROLES = ("primary_regulation", "attachment", "operational_requirement")
SECONDARY_ROLES = ("secondary_faq", "secondary_summary")
QUALITY_MULTIPLIER = {"markdown_table_artifact": 0.62, "image_placeholder": 0.72, "form_placeholder_text": 0.72, "very_short_text": 0.70}


def has(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def path_labels(path: Column) -> Column:
    """Labels of a path struct that are there, in display order."""
    return F.filter(F.array(*[path[p] for p in PATH]), lambda x: x.isNotNull() & (x != ""))


def source_priority(role: Column) -> Column:
    return F.when(role.isin(*PRIMARY_ROLES), "primary").when(role.isin(*SECONDARY_ROLES), "secondary").otherwise("unknown")


def section_type(role: Column, block_type: Column, unit_type: Column) -> Column:
    return (
        F.when(role == "attachment", "attachment")
        .when((role == "secondary_faq") | (block_type == "qa_or_faq"), "faq")
        .when(role == "secondary_summary", "abstrak")
        .when(block_type == "heading", "heading")
        .when(block_type == "table_or_row", "table")
        .otherwise(unit_type)
    )


def citation_quality(document: Column, page: Column, pasal: Column, ayat: Column, huruf: Column, section: Column) -> Column:
    return (
        F.when(~has(document), "missing_document")
        .when(~has(page), "document_only")
        .when(has(pasal) & has(ayat) & has(huruf), "document_page_pasal_ayat_huruf")
        .when(has(pasal) & has(ayat), "document_page_pasal_ayat")
        .when(has(pasal), "document_page_pasal")
        .when(has(section), "document_page_section")
        .otherwise("document_page")
    )


def citation_text(document: Column, page: Column, *labels: Column) -> Column:
    """Document, page and labels, those that are there, by commas."""
    return F.concat_ws(", ", F.when(has(document), document).otherwise("Dokumen tidak diketahui"), F.when(has(page), F.concat(F.lit("hlm. "), page.cast("string"))), *[F.nullif(x, F.lit("")) for x in labels])


def issue_flags(title: Column, page: Column, text: Column) -> Column:
    flat = normalize_space(text)
    return F.array_compact(
        F.array(
            F.when(~has(title), "missing_document_title"),
            F.when(~has(page), "missing_page"),
            F.when(F.contains(flat, F.lit("|---")), "markdown_table_artifact"),
            F.when(F.contains(flat, F.lit("![](")), "image_placeholder"),
            F.when(F.length(flat) < 30, "very_short_text"),
            F.when(F.contains(flat, F.lit("." * 16)), "form_placeholder_text"),
        )
    )


def quality_multiplier(flags: Column, allows_table: Column) -> Column:
    def factor(f: Column) -> Column:
        out = F.lit(1.0)
        for k, v in QUALITY_MULTIPLIER.items():
            out = F.when(f == k, v).otherwise(out)
        return F.when((f == "markdown_table_artifact") & allows_table, 1.0).otherwise(out)

    return F.aggregate(flags, F.lit(1.0), lambda acc, f: acc * factor(f))


def exclusion_reason(has_structure: Column, role: Column, searchable: Column, admission: Column) -> Column:
    """Why a unit stays out of the corpus; null if it doesn't."""
    return (
        F.when(~F.coalesce(has_structure, F.lit(False)), "missing_legal_structure")
        .when((role == "primary_regulation") & (searchable == False), "duplicate_primary_file")  # noqa: E712
        .when(admission == "quarantined_unreadable_table", "unreadable_table")
        .when(~F.coalesce(admission.isin("atomic_leaf", "enumeration_aggregate"), F.lit(False)), "not_citation_admitted")
    )


def admission(unit_type: Column, part: Column, text: Column, pages: Column, is_leaf: Column, readable: Column, outline_leaf: Column) -> Column:
    """atomic_leaf, enumeration_aggregate or quarantined_*; null for a unit that is no evidence at all. pages: last less first."""
    aggregate = unit_type == "enumeration_aggregate"
    atomic = (unit_type.isin("pasal", "ayat", "huruf", "angka", "table") & is_leaf) | outline_leaf
    size = F.length(text)
    oversized = (unit_type == "pasal") & (part == "normative") & (((pages >= 2) & (size > 1500)) | (size > 3000))
    dangling = text.rlike(r"(?i)\b(?:(?:pada|dalam|di)\s+)?(?:ayat|Pasal|huruf)\s*$")
    kind = (
        F.when((unit_type == "table") & ~F.coalesce(readable, F.lit(True)), "quarantined_unreadable_table")
        .when(oversized, "quarantined_oversized_normative_pasal")
        .when(part == "promulgation", "quarantined_non_evidence_document_part")
        .when(dangling, "quarantined_dangling_legal_reference")
        .when(aggregate, "enumeration_aggregate")
        .otherwise("atomic_leaf")
    )
    return F.when(atomic | aggregate, kind)


def extraction_status(pages: Column, empty_pages: Column, characters: Column) -> Column:
    """Struct (status, reason) of a parsed file."""
    reason = F.when(pages == 0, "no_pages_returned").when(characters < 100, "document_text_under_100_chars").when(empty_pages > 0.70 * pages, "more_than_70_percent_pages_empty")
    status = F.when(pages == 0, "parse_failed").when(reason.isNotNull(), "likely_needs_ocr").otherwise("extracted_ok")
    return F.struct(status.alias("status"), reason.alias("reason"))
