"""Explicit legal anchors in questions and rows, and the gates that hold a row against a question."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_term, normalize_space, tokens

# Fixed values.
YEAR = r"\b(?:19|20)\d{2}\b"
TYPE_ALIASES = {
    "POJK": ("pojk", "peraturan ojk", "peraturan otoritas jasa keuangan"),
    "SEOJK": ("seojk", "surat edaran ojk", "surat edaran otoritas jasa keuangan"),
    "PBI": ("pbi", "peraturan bank indonesia"),
    "PADG": ("padg", "peraturan anggota dewan gubernur"),
}
GENERIC_TERMS = [
    "apa", "saja", "aturan", "peraturan", "ketentuan", "terkait", "tentang", "menurut", "berdasarkan", "nomor", "tahun", "pasal", "ayat", "huruf",
    "ojk", "bi", "pojk", "pbi", "padg", "seojk", "bank", "indonesia", "perusahaan", "wajib", "kewajiban", "diwajibkan", "harus", "dipatuhi",
    "dipenuhi", "memenuhi", "penuhi", "sanksi", "denda", "tugas", "fungsi", "wewenang", "definisi", "pengertian", "berapa", "batas", "minimum",
    "maksimum", "jumlah", "terbaru", "berlaku", "status", "current", "latest", "bandingkan", "komparasi", "lembaga", "keuangan",
]
TOKEN_ALIASES = {
    "periklanan": "iklan",
    "mengiklankan": "iklan",
    "diiklankan": "iklan",
    "promo": "promosi",
    "pembawaan": "bawa",
    "membawa": "bawa",
    "dibawa": "bawa",
    "pelaporan": "lapor",
    "melaporkan": "lapor",
    "laporan": "lapor",
    "perizinan": "izin",
    "persetujuan": "izin",
    "pengaduan": "adu",
    "perlindungan": "lindung",
    "pemberian": "beri",
    "memberikan": "beri",
    "membagikan": "beri",
    "dibagikan": "beri",
    "pelanggan": "konsumen",
    "menyelesaikan": "selesai",
    "penyelesaian": "selesai",
    "perpanjangan": "perpanjang",
    "memperpanjang": "perpanjang",
    "mengirim": "sampai",
    "mengirimkan": "sampai",
    "menyampaikan": "sampai",
    "penyampaian": "sampai",
    "dipenuhi": "penuhi",
    "memenuhi": "penuhi",
}
#: Of each class: what a question says, what a claim must say.
PREDICATES = {
    "obligation": ("kewajiban|wajib|harus|diwajibkan|dipatuhi", "wajib|harus|dilarang|berkewajiban|pihak yang wajib|dengan memperhatikan ketentuan"),
    "sanction": ("sanksi|denda|terlambat|pelanggaran", "sanksi|denda|teguran|pembatasan|pencabutan|dikenai|dijatuhi"),
    "definition": ("definisi|pengertian|apa itu|yang dimaksud", "adalah|yang dimaksud|didefinisikan|selanjutnya disingkat"),
    "duties": ("tugas|fungsi|wewenang|tanggung jawab", "tugas|fungsi|wewenang|tanggung jawab|bertanggung jawab"),
    "prohibition": ("larangan|dilarang|tidak boleh|bolehkah", "dilarang|tidak boleh|larangan"),
    "permission": ("boleh|dapatkah|diizinkan", "dapat menempatkan|boleh menempatkan|diizinkan menempatkan|sepanjang memperoleh izin|tidak berlaku jika|diperbolehkan"),
}
MEASURED = r"(?:nilai|modal|persentase|rasio|jangka\s+waktu|saldo|tarif|biaya)"
VALUE_ASKED = rf"berapa|batas|jumlah|paling sedikit|paling banyak|\b{MEASURED}\s+(?:minimum|maksimum)\b|\b(?:minimum|maksimum)\s+{MEASURED}\b"
NUMBER = r"(?<![a-z])\d+(?:[.,]\d+)*(?![a-z])"
VALUE_CONTEXT = r"\b(?:rp|usd|persen|hari|bulan|tahun|jam|menit|sebesar|setara|paling\s+sedikit|paling\s+banyak)\b|%"


# What a question states, by field: the patterns that give it, in turn, and how it is written down.
ASKED = {
    "pasal": ((r"\bPasal\s+(\d+[A-Z]?)\b",), "Pasal {}", "upper"),
    "ayat": ((r"\bAyat\s*\(?\s*(\d+[a-z]?)\s*\)?", r"\bPasal\s+\d+[A-Z]?\s*\(\s*(\d+[a-z]?)\s*\)"), "({})", "lower"),
    "huruf": ((r"\bHuruf\s+([a-z])\b",), "huruf {}", "lower"),
    "regulation_type": ((r"\b(PBI|POJK|PADG|SEOJK)\b",), "{}", "upper"),
}
#: The number and the year stand in the text after the first type; of several years the last one counts.
AFTER_TYPE = r"\b(?:PBI|POJK|PADG|SEOJK)\b(.{0,80})"
NUMBER_AFTER = (r"^\s*(?:Nomor|No\.?)\s*(\d+)", r"^\s*(\d+)(?=\s*(?:/|Tahun\b))")


def constraints(query: Column) -> Column:
    """Struct of what a question states: pasal, ayat, huruf, regulation_type, regulation_number, year; null if it doesn't."""

    def first(text: Column, patterns: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?is){p}", 1), F.lit("")) for p in patterns])

    cases = {"upper": F.upper, "lower": F.lower}
    out = []
    for name, (patterns, form, case) in ASKED.items():
        before, after = form.split("{}")
        out.append(F.concat(F.lit(before), cases[case](first(query, patterns)), F.lit(after)).alias(name))
    tail = F.coalesce(first(query, [AFTER_TYPE]), F.lit(""))
    years = F.regexp_extract_all(tail, F.lit(YEAR), F.lit(0))
    return F.struct(*out, first(tail, NUMBER_AFTER).alias("regulation_number"), F.try_element_at(years, F.lit(-1)).alias("year"))


def constraints_of(query: str) -> dict[str, str]:
    """constraints() of one question in plain Python: the fields that it states."""

    def first(text: str, patterns: Sequence[str]) -> str | None:
        found = (re.search(p, text, re.I | re.S) for p in patterns)
        return next((m[1] for m in found if m), None)

    tail = first(query, [AFTER_TYPE]) or ""
    said = {name: (form, value and getattr(value, case)()) for name, (patterns, form, case) in ASKED.items() for value in [first(query, patterns)]}
    said |= {"regulation_number": ("{}", first(tail, NUMBER_AFTER)), "year": ("{}", next(reversed(re.findall(YEAR, tail)), None))}
    return {name: form.format(value) for name, (form, value) in said.items() if value}


def anchor(c: Column) -> Column:
    return F.lower(normalize_space(c))


def document_match(asked: Column, metadata: Column, number: Column, title: Column, year: Column) -> Column:
    """Type by any of its names in the metadata, number by its first digits, year by value or, without one, in the title."""
    text = F.lower(metadata)
    kind = F.lit(False)
    for k, names in TYPE_ALIASES.items():
        kind = kind | ((asked["regulation_type"] == k) & text.rlike("|".join(names)))
    digits = F.nullif(F.regexp_extract(F.coalesce(number, F.lit("")), r"\d+", 0), F.lit(""))
    n = asked["regulation_number"]
    same_number = F.coalesce(digits == n, F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\d+"), F.lit(0)).isNotNull() & F.array_contains(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\d+"), F.lit(0)), n))
    same_year = F.coalesce(F.nullif(year, F.lit("")) == asked["year"], F.contains(F.coalesce(title, F.lit("")), asked["year"]))
    return (asked["regulation_type"].isNull() | kind) & (n.isNull() | same_number) & (asked["year"].isNull() | same_year)


def path_match(asked: Column, pasal: Column, ayat: Column, huruf: Column) -> Column:
    """Every anchor asked for is the row's; a missing one fails."""
    out = F.lit(True)
    for name, c in (("pasal", pasal), ("ayat", ayat), ("huruf", huruf)):
        out = out & (asked[name].isNull() | F.coalesce(anchor(c) == anchor(asked[name]), F.lit(False)))
    return out


def sector_scope(query: Column, title: Column, broad: str, narrow: Sequence[str], exempt: str | None = None) -> Column:
    """A question of the broad sector that names no narrow one takes no titles of the narrow one."""
    def any_narrow(c: Column) -> Column:
        out = F.lit(False)
        for t in narrow:
            out = out | F.contains(F.lower(c), F.lit(t))
        return out

    asks = contains_term(query, broad) & ~any_narrow(query)
    if exempt:
        asks = asks & ~F.contains(F.lower(query), F.lit(exempt))
    return ~(asks & any_narrow(title))


def _alias(t: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOKEN_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), t)


def distinctive_terms(query: Column, stopwords: Sequence[str] = ()) -> Column:
    own = F.filter(tokens(query, stopwords), lambda t: ~t.isin(GENERIC_TERMS) & ~t.rlike(r"^\d+(?:[/.]\d+)*$"))
    return F.array_distinct(F.transform(own, _alias))


def evidence_terms(document: Column, claim: Column, stopwords: Sequence[str] = ()) -> Column:
    return F.array_distinct(F.transform(tokens(F.concat_ws(" ", document, claim), stopwords), _alias))


def value_required(query: Column) -> Column:
    return F.lower(query).rlike(VALUE_ASKED)


def value_matches(claim: Column) -> Column:
    return F.lower(claim).rlike(NUMBER) & F.lower(claim).rlike(VALUE_CONTEXT)


def predicate_support(query: Column, claim: Column) -> tuple[Column, Column]:
    """(names of the classes asked for, whether the claim supports one; true if none is asked for)."""
    q, c = F.lower(query), F.lower(claim)
    asked = F.array_compact(F.array(*[F.when(q.rlike(a), n) for n, (a, _) in PREDICATES.items()]))
    found = F.lit(False)
    for a, b in PREDICATES.values():
        found = found | (q.rlike(a) & c.rlike(b))
    return asked, (F.size(asked) == 0) | found


def legal_anchor(query: Column, claim: Column) -> tuple[Column, Column]:
    names = ("izin", "persetujuan")
    asked = F.array_compact(F.array(*[F.when(contains_term(query, n), n) for n in names]))
    found = F.lit(False)
    for n in names:
        found = found | (contains_term(query, n) & contains_term(claim, n))
    return asked, (F.size(asked) == 0) | found


def alignment(query: Column, document: Column, claim: Column, ratio: float | Column = 0.75, allow_missing_value: bool | Column = False, allow_missing_predicate: bool | Column = False, stopwords: Sequence[str] = ()) -> Column:
    """Struct: accepted, the distinctive terms and those found, their ratio, and the reasons against."""
    ratio, no_value, no_predicate = (x if isinstance(x, Column) else F.lit(x) for x in (ratio, allow_missing_value, allow_missing_predicate))
    wanted = distinctive_terms(query, stopwords)
    hit = F.filter(F.array_intersect(wanted, evidence_terms(document, claim, stopwords)), lambda t: t.isNotNull())
    n = F.size(wanted)
    terms_ok = (n == 0) | (F.size(hit) >= F.greatest(F.lit(1), F.ceil(n * ratio)))
    classes, predicate_ok = predicate_support(query, claim)
    anchors, anchor_ok = legal_anchor(query, claim)
    asks_value = value_required(query)
    value_ok = ~asks_value | value_matches(claim)
    names = F.array_join(classes, "|")
    both = no_value & no_predicate & (F.size(classes) > 0) & asks_value
    reasons = F.array_compact(
        F.array(
            F.when(~terms_ok, "insufficient_distinctive_query_alignment"),
            F.when(~predicate_ok, F.concat(F.when(no_predicate, "predicate_deferred_for_compound_query:").otherwise("predicate_not_supported:"), names)),
            F.when(~anchor_ok, F.concat(F.lit("legal_anchor_not_supported:"), F.array_join(anchors, "|"))),
            F.when(~value_ok & ~no_value, "requested_value_not_supported"),
            F.when(~value_ok & no_value, "requested_value_deferred_for_ambiguity"),
        )
    )
    accepted = terms_ok & (predicate_ok | no_predicate) & anchor_ok & (value_ok | no_value) & (~both | (predicate_ok & F.lit(True)) | (value_ok & asks_value))
    return F.struct(
        accepted.alias("accepted"), wanted.alias("distinctive_terms"), hit.alias("matched_distinctive_terms"), F.round(F.when(n == 0, 1.0).otherwise(F.size(hit) / n), 3).alias("distinctive_ratio"),
        names.alias("predicate"), predicate_ok.alias("predicate_matched"), anchor_ok.alias("legal_anchor_matched"), asks_value.alias("value_required"), value_ok.alias("value_matched"), reasons.alias("reasons"),
    )


def is_outline_kind(kind: Column) -> Column:
    """Circular letters have the outline grammar."""
    return F.coalesce(F.lower(kind).rlike("seojk|surat edaran ojk"), F.lit(False))


def wants_compound(query: Column) -> Column:
    """Questions that ask for two rules at once."""
    q = F.lower(query)

    def has(*terms: str) -> Column:
        return q.rlike("|".join(map(re.escape, terms)))

    return has(" dan kapan ") | (has("psps") & has("pspk")) | has("klausula eksonerasi") | (has("data") & has("pihak lain", "perusahaan lain") & has("pemberian", "memberikan", "membagikan"))


def alignment_ratio(query: Column, ambiguity: Column) -> Column:
    return F.when(ambiguity.isNotNull() | wants_compound(query), 0.25).otherwise(0.75)


def is_lifecycle_question(query: Column) -> Column:
    return F.lower(query).rlike(r"masih berlaku|sudah dicabut|telah dicabut|status (?:berlaku|keberlakuan)|status peraturan|dicabut oleh|menggantikan|diubah oleh")


def has_lifecycle(*fields: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | (f.isNotNull() & ~f.cast("string").isin("", "unknown", "[]"))
    return out
