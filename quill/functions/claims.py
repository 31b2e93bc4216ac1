"""Claims: cleaning, usability, boilerplate classes, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space

# Fixed values.
NOISE = {
    "legal_preamble": r"(?i)DENGAN\s+RAHMAT\s+TUHAN\s+YANG\s+MAHA\s+ESA|^(?:SALINAN\s+)?PERATURAN\s+(?:OTORITAS\s+JASA\s+KEUANGAN|BANK\s+INDONESIA|ANGGOTA\s+DEWAN\s+GUBERNUR)(?:\s+REPUBLIK\s+INDONESIA)?\s+NOMOR\b|^(?:SALINAN\s+)?SURAT\s+EDARAN\s+(?:OTORITAS\s+JASA\s+KEUANGAN|BANK\s+INDONESIA)(?:\s+REPUBLIK\s+INDONESIA)?\s+NOMOR\b|^(?:OTORITAS\s+JASA\s+KEUANGAN|BANK\s+INDONESIA)\s+REPUBLIK\s+INDONESIA",
    "consideration": r"(?i)\bMenimbang\s*:|\bkonsiderans\b",
    "legal_basis_reference": r"(?i)\bMengingat\s*:",
    "enactment": r"(?i)\bMEMUTUSKAN\s*:|\bMenetapkan\s*:",
    "promulgation": r"(?i)Lembaran\s+Negara|\bDiundangkan\s+di\b|\bDitetapkan\s+di\b|\bMENTERI\s+HUKUM\s+DAN\s+HAK\s+ASASI\s+MANUSIA\b",
    "letter_intro": r"(?i)Sehubungan\s+dengan\s+amanat|\bYth\.?\s+(?:Direksi|Pengurus|Dewan\s+Komisioner)",
}
NOISE_PENALTY = {"legal_preamble": -120.0, "consideration": -100.0, "legal_basis_reference": -90.0, "enactment": -100.0, "promulgation": -120.0, "letter_intro": -90.0}
NOISE_ASKED = {
    "legal_preamble": "dengan rahmat|preambule|pembukaan",
    "consideration": "menimbang|pertimbangan|konsiderans|latar belakang penerbitan",
    "legal_basis_reference": "mengingat|dasar hukum|rujukan undang-undang|landasan hukum",
    "enactment": "memutuskan|menetapkan|amar putusan|penetapan",
    "promulgation": "lembaran negara|tambahan lembaran negara|diundangkan|ditetapkan di|tanggal berlaku",
    "letter_intro": "sehubungan dengan amanat|yth direksi|surat edaran",
}
REJECT_PREFIXES = ("peraturan otoritas", "peraturan bank indonesia", "dengan rahmat", "menimbang", "penjelasan atas", "aktivitas dan perizinan", "bagian kesatu", "paragraf")
REJECT = r"lembaran negara|tambahan lembaran negara|sehubungan dengan amanat|^\(?\d+[a-z]?\)?\s+(?:bagi|untuk|atau|dan)\b|^dimaksud dalam\b|^sebagaimana dimaksud\b"
ALL_CAPS = r"^[A-Z\s/.\-0-9()]{40,}$"
INCOMPLETE = r"(?i)(?:[:;]|dan/atau)$|\b(?:sebagaimana dimaksud|yang dimaksud|terdiri atas|meliputi|mencakup|berupa|dilakukan melalui)$"
STRIP = (r"^\.\.\.", r"\.\.\.$", r"!\[[^\]]*\]\([^)]+\)", r"\|[-:\s|]+\|", r"^#+\s*")
TABLE_WORDS = "tabel|table|matriks|lampiran|formulir|format|template|kolom|xlsx|excel"


def clean(text: Column) -> Column:
    v = normalize_space(text)
    for p in STRIP:
        v = F.regexp_replace(v, p, " ")
    return normalize_space(F.regexp_replace(v, r"\|", "; "))


def claim_text(text: Column, is_aggregate: Column, limit: int = 420, aggregate_limit: int = 4000, boundary: int = 180) -> Column:
    """The cleaned text, cut at the last sentence end or blank before the limit."""
    v = clean(text)
    most = F.when(is_aggregate, aggregate_limit).otherwise(limit)
    head = F.substr(v, F.lit(1), most)
    sentence = F.regexp_extract(head, r"^(.*[.;])\s", 1)
    blank = F.regexp_extract(head, r"^(.*)\s", 1)
    short = F.when(F.length(sentence) >= boundary, sentence).when(F.length(blank) >= boundary, blank).otherwise(head)
    return F.when(F.length(v) <= most, v).otherwise(F.rtrim(short))


def complete(claim: Column) -> Column:
    v = normalize_space(claim)
    return (v != "") & ~v.rlike(INCOMPLETE)


def usable(query: Column, claim: Column, section: Column, flags: Column, shortest: int = 30) -> Column:
    low, q = F.lower(claim), F.lower(query)
    prefixed = F.lit(False)
    for p in REJECT_PREFIXES:
        prefixed = prefixed | low.startswith(p)
    tables, forms = q.rlike(TABLE_WORDS), q.rlike("formulir|format|template|lampiran")
    bad = F.exists(flags, lambda f: f.isin("image_placeholder", "very_short_text") | ((f == "markdown_table_artifact") & ~tables) | ((f == "form_placeholder_text") & ~forms))
    return (F.length(claim) >= shortest) & ~prefixed & ~low.rlike(REJECT) & ~claim.rlike(ALL_CAPS) & ~(F.coalesce(section == "table", F.lit(False)) & ~tables) & ~bad


def noise_category(text: Column) -> Column:
    out = F.lit("substantive")
    for name, pattern in reversed(NOISE.items()):
        out = F.when(normalize_space(text).rlike(pattern), name).otherwise(out)
    return out


def noise_allowed(query: Column, category: Column) -> Column:
    out = category == "substantive"
    for name, words in NOISE_ASKED.items():
        out = out | ((category == name) & F.lower(query).rlike(words))
    return out


def noise_penalty(query: Column, category: Column) -> Column:
    p = F.lit(0.0)
    for name, v in NOISE_PENALTY.items():
        p = F.when(category == name, v).otherwise(p)
    return F.when(noise_allowed(query, category), 0.0).otherwise(p)


def rank(
    query: Column, query_terms: Column, claim: Column, claim_terms: Column, support: Column, section: Column, quality: Column, kind: Column, anchor_text: Column, phrases: Column,
    verbs: Sequence[str] = ("menempatkan", "menyampaikan", "memberikan", "melaporkan"),
) -> Column:
    """Additive rank of a claim as an answer to a question."""
    q, c, a = F.lower(query), F.lower(claim), F.lower(anchor_text)
    q_set = F.array_distinct(query_terms)
    overlap = F.when(F.size(q_set) > 0, 12.0 * F.size(F.array_intersect(q_set, claim_terms)) / F.size(q_set)).otherwise(0.0)
    keys = F.filter(q_set, lambda t: (F.length(t) >= 4) & ~t.isin("apa", "saja", "aturan", "peraturan", "terkait", "tentang", "bank", "ojk", "bi"))
    hits = F.size(F.filter(keys, lambda t: F.contains(a, t)))
    short_hits = F.size(F.filter(keys, lambda t: (F.length(t) <= 5) & F.contains(a, t)))
    anchor = F.least(F.lit(28.0), hits * 8.0 + short_hits * 10.0)
    obliged = q.rlike("kewajiban|wajib|harus|dipatuhi|pelapor|pelaporan|menyampaikan") & c.rlike("wajib|harus|dilarang|pelapor adalah|menyampaikan laporan|menyusun dan menyampaikan")
    defined = q.rlike("apa itu|pengertian|definisi|yang dimaksud") & c.rlike("yang dimaksud dengan|adalah|yang selanjutnya disingkat")
    fragment = c.rlike(r"^\(?\d+[a-z]?\)?\s+(?:bagi|untuk|dalam hal|atau|dan)\b|^dimaksud dalam\b|^sebagaimana dimaksud\b")
    unfinished = (F.length(c) <= 140) & c.rlike("(?:meliputi:|yaitu:|adalah:|sebesar:|dan/atau)$")
    quality_bonus = (
        F.when(obliged, 14.0).otherwise(0.0) + F.when(defined, 10.0).otherwise(0.0) + F.when(fragment, -18.0).otherwise(0.0) + F.when(unfinished, -6.0).otherwise(0.0)
        + F.when(F.contains(q, F.lit("perpanjangan")), F.when(c.rlike("memperpanjang|perpanjangan"), 24.0).otherwise(-40.0)).otherwise(0.0)
    )
    sanction = "sanksi|denda|terlambat|pelanggaran"
    permission = (F.trim(q).rlike("^(?:bolehkah|dapatkah) ") | (F.contains(q, F.lit("data")) & F.contains(q, F.lit("pihak lain")))) & c.rlike("persetujuan|tidak berlaku jika|diperbolehkan|dapat memberikan")
    verb = F.lit(0.0)
    for v in verbs:
        verb = verb + F.when(F.contains(q, F.lit(v)) & c.rlike(rf"\b(?:wajib|harus|dapat|dilarang)\b(?:\s+\w+){{0,3}}\s+{v}\b"), 35.0).otherwise(0.0)
    k = F.lower(normalize_space(kind))
    governs = F.when(q.rlike("padg|seojk"), 0.0).when(k.isin("pbi", "peraturan bank indonesia", "pojk", "peraturan ojk", "peraturan otoritas jasa keuangan"), 18.0).when(
        k.isin("padg", "peraturan anggota dewan gubernur", "seojk", "surat edaran ojk"), -12.0
    ).otherwise(0.0)
    prefix = F.when(c.rlike("^(?:peraturan otoritas|peraturan bank indonesia|dengan rahmat|menimbang)"), -10.0).otherwise(0.0)
    explained = F.when(~q.rlike("definisi|pengertian|yang dimaksud") & c.rlike(r"^\(?\d+[a-z]?\)?\s+yang dimaksud dengan\b"), -35.0).otherwise(0.0)
    return (
        support + overlap + 8.0 * F.size(phrases) + anchor + quality_bonus + F.when(q.rlike(sanction) & c.rlike(sanction), 10.0).otherwise(0.0) + F.when(permission, 24.0).otherwise(0.0) + verb
        + F.when(section.isin("ayat", "pasal"), 4.0).when(section == "table", -6.0).otherwise(0.0) + F.when(quality == "document_page_pasal_ayat", 3.0).otherwise(0.0) + governs
        + noise_penalty(query, noise_category(claim)) + prefix + explained
    )
