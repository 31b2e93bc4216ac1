"""Catalogue metadata: schema-on-read values to canonical fields. All total: bad values come out as null or as they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_value, normalize_space, slugify

# Fixed values.
REGULATION_TYPES = ("SEOJK", "POJK", "PADK", "PBI", "PADG", "SEBI", "UU", "PP", "PMK", "SK DIR")
ISSUER_OF_TYPE = {"PBI": "BI", "PADG": "BI", "POJK": "OJK", "SEOJK": "OJK"}
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")
STATUS = {
    "berlaku": "active",
    "aktif": "active",
    "active": "active",
    "current": "active",
    "dicabut": "repealed",
    "dicabut sebagian": "partially_repealed",
    "repealed": "repealed",
    "diganti": "superseded",
    "superseded": "superseded",
    "diubah": "amended",
    "amended": "amended",
}
NOT_CURRENT = ("repealed", "partially_repealed", "superseded")
YEAR = r"(?:19|20)\d{2}"


def nullable(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_year(*values: Column) -> Column:
    """First year from 1900 to 2099 in the first value that has one."""
    return F.coalesce(*[nullable(F.regexp_extract(F.coalesce(v, F.lit("")), YEAR, 0)) for v in values])


def normalize_date(c: Column) -> Column:
    """ISO date of m/d/Y, d/m/Y, Y-m-d or a day, a month's name and a year; else the value itself; null for nothing."""
    v = normalize_space(c)
    numeric = F.coalesce(*[F.date_format(F.try_to_timestamp(v, F.lit(f)), "yyyy-MM-dd") for f in ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d")])
    named = rf"(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+({YEAR})"
    low = F.lower(v)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, named, 2))
    spelled = F.when(month > 0, F.concat_ws("-", F.regexp_extract(low, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, named, 1), 2, "0")))
    return F.when(v != "", F.coalesce(numeric, spelled, v))


def first_payload_value(*values: Column) -> Column:
    return first_value(*values)


def relation_values(c: Column) -> Column:
    """Elements of a JSON array, else parts between semicolons, bars or line ends; the empty ones are left out."""
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>"))
    parts = F.transform(F.coalesce(listed, F.split(F.coalesce(c, F.lit("")), r"\s*(?:;|\||\n)\s*")), normalize_space)
    return F.filter(parts, lambda x: x != "")


def map_values(c: Column, table: Mapping[str, str]) -> Column:
    out = c
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def lifecycle_status(c: Column) -> Column:
    return nullable(map_values(F.lower(normalize_space(c)), STATUS))


def is_current(explicit: Column, status: Column) -> Column:
    return F.coalesce(explicit, F.when(status == "active", True).when(status.isin(*NOT_CURRENT), False))


def regulation_type(value: Column, title: Column) -> Column:
    """First known type in value and title, in the order of the list; else the value."""
    joined = F.upper(F.concat_ws(" ", value, title))
    out = nullable(normalize_space(value))
    for t in reversed(REGULATION_TYPES):
        out = F.when(F.contains(joined, F.lit(t)), t).otherwise(out)
    return out


def regulation_number(number: Column, title: Column | None = None) -> Column:
    """The number in lower case with forward slashes; without one, the number that the title states."""
    own = F.lower(F.replace(normalize_space(number), F.lit("\\"), F.lit("/")))
    if title is None:
        return nullable(own)
    t = normalize_space(title)
    slashed = F.regexp_extract(t, rf"(?i)(?:No\.?|Nomor)\s*([0-9]+(?:/[A-Za-z0-9.\-]+)*/{YEAR})", 1)
    worded = rf"(?i)(?:No\.?|Nomor)\s*([0-9]+)\s*Tahun\s*({YEAR})"
    stated = F.when(F.regexp_extract(t, worded, 1) != "", F.concat(F.regexp_extract(t, worded, 1), F.lit(" tahun "), F.regexp_extract(t, worded, 2)))
    return F.coalesce(nullable(own), F.lower(nullable(slashed)), stated)


def match_key(issuer: Column, kind: Column, number: Column, year: Column | None = None) -> Column:
    """Issuer, type and number (and year), by bars; null without issuer or number."""
    parts = [F.upper(issuer), F.upper(F.coalesce(kind, F.lit(""))), regulation_number(number)]
    if year is not None:
        parts.append(F.coalesce(year, F.lit("")))
    return F.when(nullable(issuer).isNotNull() & regulation_number(number).isNotNull(), F.concat_ws("|", *parts))


def canonical_id(issuer: Column, kind: Column, number: Column, year: Column, title: Column) -> Column:
    known = nullable(kind).isNotNull() & nullable(number).isNotNull()
    add_year = nullable(year).isNotNull() & ~F.contains(number, year)
    base = F.concat_ws(":", issuer, kind, number, F.when(add_year, year))
    return slugify(F.when(known, base).otherwise(F.concat_ws(":", issuer, F.lit("unknown"), F.coalesce(title, F.lit("")))))


def series_key(issuer: Column, kind: Column, number: Column) -> Column:
    """The key without the number's year."""
    plain = F.regexp_replace(F.coalesce(regulation_number(number), F.lit("unknown")), rf"(?i)(?:/|\s+tahun\s+){YEAR}$", "")
    return slugify(F.concat_ws(":", issuer, F.coalesce(nullable(kind), F.lit("unknown")), plain))


def host_issuer(source: Column, bi_sources: Sequence[str] = ("ease-bi",)) -> Column:
    return F.when(source.isin(*bi_sources), "BI").otherwise("OJK")


def issuer(source: Column, kind: Column) -> Column:
    """The instrument decides before the host does."""
    out = host_issuer(source)
    for k, v in ISSUER_OF_TYPE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def file_role(source: Column, kind: Column, label: Column) -> Column:
    text = F.concat_ws(" ", F.lower(normalize_space(kind)), F.lower(normalize_space(label)))

    def has(*terms: str) -> Column:
        return text.rlike("|".join(terms))

    return (
        F.when(has("faq", "ringkasan", "infografis"), "secondary_faq")
        .when(has("abstrak", "summary"), "secondary_summary")
        .when(has("lampiran"), "attachment")
        .when((source == "ease-bi") & has("dokumen", "pedoman", "persyaratan", "matriks"), "operational_requirement")
        .otherwise("primary_regulation")
    )


# Names a payload may give to one field, in order.
ALIASES = {
    "issued_date": ("issued_date", "issuance_date", "publication_date", "date_issued", "tanggal_terbit", "tanggal_penetapan", "date"),
    "effective_date": ("effective_date", "berlaku_mulai", "tanggal_berlaku", "date"),
    "repeal_date": ("repeal_date", "revoked_date", "tanggal_pencabutan", "tanggal_dicabut"),
    "lifecycle_status": ("lifecycle_status", "status", "document_status"),
    "supersedes": ("supersedes", "replaces", "superseded_regulations", "mencabut"),
    "amends": ("amends", "amended_regulations", "changes", "mengubah"),
}


IDENTITY = ("record_id", "law_id", "header_id", "source_url", "detail_url")
PLAIN = ("title", "regulation_type", "number", "year", "is_current", "current", "sector", "sub_sector", "bank_slug", "bank_name", "group_path", "fetched_at")


def normalize_records(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """records (source, path, payload: a JSON object) to canonical fields. A payload is parsed once; a value that isn't
    text comes as its JSON text. Fields that a payload lacks, or has empty, are null."""
    names = dict.fromkeys([*PLAIN, *IDENTITY, *(n for group in ALIASES.values() for n in group)])
    schema = ", ".join(f"{n} string" for n in names) + ", list_item struct<group_path:string, full_text_url:string>"
    p = records.select(*keep, "source", "path", F.from_json("payload", schema).alias("p")).select(*keep, "source", "path", "p.*")

    def get(*options: str) -> Column:
        return F.coalesce(*[nullable(F.col(n)) for n in options])

    source = F.col("source")
    first = p.select(
        *keep, "source", "list_item", *[n for n in ("sector", "sub_sector", "bank_slug", "bank_name", "group_path", "fetched_at")],
        F.coalesce(*[nullable(F.col(n)) for n in IDENTITY], F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("source_id"), get("detail_url", "source_url").alias("url"),
        normalize_space(get("title")).alias("title"), get("regulation_type").alias("kind"), get("number").alias("stated_number"), get("year").alias("stated_year"),
        *[normalize_date(get(*ALIASES[n])).alias(n) for n in ("issued_date", "effective_date", "repeal_date")],
        lifecycle_status(get(*ALIASES["lifecycle_status"])).alias("lifecycle_status"), get("is_current", "current").try_cast("boolean").alias("explicit"),
        *[relation_values(get(*ALIASES[n])).alias(n) for n in ("supersedes", "amends")],
    )
    second = first.withColumns({"regulation_type": regulation_type(F.col("kind"), F.col("title")), "number": regulation_number(F.col("stated_number"), F.col("title"))})
    third = second.withColumns({
        "year": F.coalesce("stated_year", parse_year(F.col("issued_date"), F.col("effective_date"), F.col("number"), F.col("title"))),
        "issuer": issuer(source, F.col("regulation_type")), "hosting_source_issuer": host_issuer(source),
    })
    version = canonical_id(F.col("issuer"), F.col("regulation_type"), F.col("number"), F.col("year"), F.col("title"))
    return third.select(
        *keep, version.alias("canonical_id"), version.alias("regulation_version_key"), series_key(F.col("issuer"), F.col("regulation_type"), F.col("number")).alias("regulation_series_key"),
        "issuer", "hosting_source_issuer", F.when(F.col("regulation_type").isin(*ISSUER_OF_TYPE), "regulation_type").otherwise("hosting_source").alias("issuer_resolution_basis"),
        (F.col("issuer") != F.col("hosting_source_issuer")).alias("issuer_differs_from_host"), "source", "source_id", "title", "regulation_type", "number", "year", "issued_date", "effective_date", "repeal_date",
        "lifecycle_status", is_current(F.col("explicit"), F.col("lifecycle_status")).alias("is_current"), "supersedes", "amends", "sector", "sub_sector", "bank_slug", "bank_name",
        F.coalesce(nullable(F.col("group_path")), nullable(F.col("list_item.group_path"))).alias("group_path"), F.coalesce("url", nullable(F.col("list_item.full_text_url"))).alias("source_url"), "fetched_at",
    )
