"""Catalogue, metadata, tables, citations, corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citation as ci
from ..functions import metadata as md
from ..functions import tables as tb
from ..functions import text as t
from ..operators import catalog as ca
from .base import DOCS, UNITS, docs, query, table, units

SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, substr(sha1(p_name), 1, 12) AS hash, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS clean FROM part")
def text_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", t.slugify(F.col("p_name")).alias("slug"), t.short_hash(F.col("p_name")).alias("hash"), t.normalize_space(F.col("p_name")).alias("clean"))


RECORDS = """rec AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ease-bi' ELSE 'peraturan-ojk' END AS source,
  CASE o_orderkey % 4 WHEN 0 THEN 'PBI' WHEN 1 THEN 'SEOJK' WHEN 2 THEN 'POJK' ELSE 'Keputusan' END AS kind,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS VARCHAR) || '\\' || CAST(year(o_orderdate) AS VARCHAR) END AS number,
  'Peraturan Nomor ' || CAST(o_custkey AS VARCHAR) || ' Tahun ' || CAST(year(o_orderdate) AS VARCHAR) || ' tentang  ' || o_orderpriority AS title,
  strftime(o_orderdate, '%-d/%-m/%Y') AS day, CASE o_orderstatus WHEN 'F' THEN 'Dicabut' WHEN 'O' THEN ' Berlaku' ELSE '' END AS status FROM orders)"""


def _records(spark, sf_dir):
    year = F.year("o_orderdate").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "ease-bi").otherwise("peraturan-ojk").alias("source"),
        F.when(F.col("o_orderkey") % 4 == 0, "PBI").when(F.col("o_orderkey") % 4 == 1, "SEOJK").when(F.col("o_orderkey") % 4 == 2, "POJK").otherwise("Keputusan").alias("kind"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.col("o_custkey").cast("string"), F.lit("\\"), year)).alias("number"),
        F.concat(F.lit("Peraturan Nomor "), F.col("o_custkey").cast("string"), F.lit(" Tahun "), year, F.lit(" tentang  "), F.col("o_orderpriority")).alias("title"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("day"), F.when(F.col("o_orderstatus") == "F", "Dicabut").when(F.col("o_orderstatus") == "O", " Berlaku").otherwise("").alias("status"),
    )


META = (
    RECORDS
    + """, a AS (SELECT *, coalesce(replace(number, '\\', '/'), lower(regexp_extract(title, 'Nomor ([0-9]+) Tahun', 1) || ' tahun ' || regexp_extract(title, 'Tahun ([0-9]+)', 1))) AS num,
  regexp_extract(title, '(19|20)[0-9][0-9]') AS year, nullif(CASE lower(trim(status)) WHEN 'dicabut' THEN 'repealed' WHEN 'berlaku' THEN 'active' ELSE '' END, '') AS st,
  CASE WHEN kind = 'PBI' THEN 'BI' WHEN kind IN ('SEOJK', 'POJK') THEN 'OJK' WHEN source = 'ease-bi' THEN 'BI' ELSE 'OJK' END AS issuer FROM rec)"""
)


@query(
    f"""WITH {META} SELECT id, issuer, CASE WHEN source = 'ease-bi' THEN 'BI' ELSE 'OJK' END AS host, kind AS regulation_type, num AS number,
  CAST(CASE WHEN TRY_CAST(split_part(day, '/', 1) AS INTEGER) <= 12 THEN split_part(day, '/', 3) || '-' || lpad(split_part(day, '/', 1), 2, '0') || '-' || lpad(split_part(day, '/', 2), 2, '0')
    ELSE split_part(day, '/', 3) || '-' || lpad(split_part(day, '/', 2), 2, '0') || '-' || lpad(split_part(day, '/', 1), 2, '0') END AS VARCHAR) AS issued_date,
  st AS status, CASE st WHEN 'active' THEN true WHEN 'repealed' THEN false END AS is_current, year FROM a"""
)
def metadata_normalise(spark, sf_dir):
    r = _records(spark, sf_dir)
    payload = F.to_json(F.struct("title", F.col("kind").alias("regulation_type"), "number", F.col("day").alias("issued_date"), "status"))
    out = md.normalize_records(r.select("id", "source", F.lit("x/y.json").alias("path"), payload.alias("payload")), keep=("id",))
    return out.select("id", "issuer", F.col("hosting_source_issuer").alias("host"), "regulation_type", "number", "issued_date", F.col("lifecycle_status").alias("status"), "is_current", md.parse_year(F.col("title")).alias("year"))


@query(
    f"WITH {META} SELECT id, {SLUG.format("issuer || ':' || kind || ':' || num || CASE WHEN contains(num, year) THEN '' ELSE ':' || year END")} AS canonical_id, "
    f"{SLUG.format("issuer || ':' || kind || ':' || regexp_replace(num, '(/| tahun )(19|20)[0-9][0-9]$', '')")} AS series_key, "
    "issuer || '|' || kind || '|' || num || '|' || year AS match_key FROM a"
)
def canonical_ids(spark, sf_dir):
    r = _records(spark, sf_dir)
    num = md.regulation_number(F.col("number"), F.col("title"))
    who, year = md.issuer(F.col("source"), F.col("kind")), md.parse_year(F.col("title"))
    return r.select(
        "id", md.canonical_id(who, F.col("kind"), num, year, F.col("title")).alias("canonical_id"), md.series_key(who, F.col("kind"), num).alias("series_key"),
        F.concat_ws("|", who, "kind", num, year).alias("match_key"),
    )


@query(
    """SELECT p_partkey, CASE WHEN h LIKE '%faq%' OR h LIKE '%ringkasan%' OR h LIKE '%infografis%' THEN 'secondary_faq' WHEN h LIKE '%abstrak%' OR h LIKE '%summary%' THEN 'secondary_summary' WHEN h LIKE '%lampiran%' THEN 'attachment'
  WHEN p_partkey % 2 = 0 AND (h LIKE '%dokumen%' OR h LIKE '%matriks%' OR h LIKE '%pedoman%' OR h LIKE '%persyaratan%') THEN 'operational_requirement' ELSE 'primary_regulation' END AS role
FROM (SELECT p_partkey, lower(['FAQ', 'Abstrak', 'Lampiran', 'Matriks', 'Naskah'][CAST(p_partkey % 5 AS INTEGER) + 1] || ' ' || p_type) AS h FROM part)"""
)
def file_roles(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("FAQ", "Abstrak", "Lampiran", "Matriks", "Naskah")))[(F.col("p_partkey") % 5).cast("int")]
    source = F.when(F.col("p_partkey") % 2 == 0, "ease-bi").otherwise("peraturan-ojk")
    return table(spark, sf_dir, "part").select("p_partkey", md.file_role(source, kinds, F.col("p_type")).alias("role"))


DUPES = f"""{DOCS}, g AS (SELECT doc_id, sha256(text) AS sha, lang, count(*) OVER w AS n, first_value(doc_id) OVER (PARTITION BY lang, sha256(text) ORDER BY issuer <> 'BI', doc_id) AS best FROM docs WINDOW w AS (PARTITION BY lang, sha256(text)))"""


@query(
    f"""WITH {DUPES} SELECT doc_id, n = 1 OR doc_id = best AS searchable, CASE WHEN n = 1 THEN 'unique' WHEN doc_id = best THEN 'preferred' ELSE 'duplicate' END AS duplicate_status,
  CASE WHEN n > 1 THEN 'primary-duplicate-' || substr(sha1(lang || ':' || sha), 1, 12) END AS group_id, CASE WHEN n > 1 AND doc_id <> best THEN best END AS duplicate_of, n AS group_size FROM g"""
)
def exact_duplicates(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", "issuer", F.sha2("text", 256).alias("sha"))
    return ca.annotate_duplicates(d, "lang", "sha", "doc_id", F.col("issuer") != "BI").drop("lang", "issuer", "sha")


@query(f"WITH {DOCS} SELECT doc_id, lang, CAST(size AS INTEGER) AS size FROM (SELECT doc_id, lang, length(text) AS size, count(*) OVER (PARTITION BY lang, length(text)) AS n FROM docs) WHERE n > 1")
def lazy_hash_groups(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", F.length("text").alias("size"))
    return ca.worth_hashing(d, "lang", "size").select("doc_id", "lang", "size")


@query(
    "SELECT count(*) FILTER (c.k IS NOT NULL AND o.k IS NOT NULL) AS matched, count(*) FILTER (o.k IS NULL) AS left_only, count(*) FILTER (c.k IS NULL) AS right_only "
    "FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k"
)
def coverage_full_outer(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return ca.coverage(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') "
    "UNION ALL SELECT o_orderkey, round(o_totalprice * 2, 2) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'"
)
def replace_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    gone = o.where("o_orderstatus = 'F'")
    new = gone.where("o_orderpriority <> '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return ca.replace_by_key(o, new, gone, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return ca.remaining(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query(
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a/' || p_name WHEN 2 THEN 'old/' || p_name ELSE 'x/none' || p_partkey END AS saved_path FROM part), l AS (SELECT DISTINCT 'a/' || p_name AS path, p_name AS base FROM part)
SELECT p_partkey, CASE WHEN saved_path IS NULL THEN NULL WHEN e.path IS NOT NULL THEN saved_path WHEN n.path IS NOT NULL THEN n.path ELSE saved_path END AS resolved_path,
  saved_path IS NOT NULL AND (e.path IS NOT NULL OR n.path IS NOT NULL) AS exists, CASE WHEN saved_path IS NULL THEN 'missing_saved_path' WHEN e.path IS NULL AND n.path IS NULL THEN 'file_not_found' END AS error
FROM f LEFT JOIN l e ON e.path = saved_path LEFT JOIN l n ON n.base = split_part(saved_path, '/', 2)"""
)
def resolve_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    saved = F.when(k % 4 == 1, F.concat(F.lit("a/"), "p_name")).when(k % 4 == 2, F.concat(F.lit("old/"), "p_name")).when(k % 4 == 3, F.concat(F.lit("x/none"), k.cast("string")))
    listing = p.select(F.concat(F.lit("a/"), "p_name").alias("path"), F.col("p_name").alias("basename")).distinct()
    return ca.resolve_paths(p.select("p_partkey", saved.alias("saved_path")), listing).drop("saved_path")


@query(
    "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(dayofweek(ts) + 1 AS VARCHAR), count(*) FROM events GROUP BY 2 "
    "UNION ALL SELECT 'big', CASE WHEN value > 50 THEN 'true' ELSE 'false' END, count(*) FROM events GROUP BY 2"
)
def grouping_sets_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.dayofweek("ts").alias("weekday"), (F.col("value") > 50).alias("big"))
    return ca.profile(e, ["event_type", "weekday", "big"])


@query(
    f"""WITH {DOCS} SELECT 'title' AS "column", count(*) FILTER (title IS NULL OR title = '') AS n_null FROM docs UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR lang = '') FROM docs UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR source = '') FROM docs"""
)
def catalog_audit(spark, sf_dir):
    return ca.null_counts(docs(spark, sf_dir), ["title", "lang", "source"])


@query(f"WITH {DOCS} SELECT title, count(*) AS n FROM docs GROUP BY title HAVING count(*) >= 2")
def duplicate_titles(spark, sf_dir):
    return ca.duplicate_groups(docs(spark, sf_dir), "title")


RULES = "CASE r WHEN 1 THEN 'missing_text' WHEN 2 THEN 'short_text' WHEN 3 THEN 'late_page' ELSE 'deep_level' END"


@query(
    f"""WITH {UNITS}, v AS (SELECT doc_id, pos, 'missing_text' AS rule FROM units WHERE line = '' UNION ALL SELECT doc_id, pos, 'short_text' FROM units WHERE length(line) BETWEEN 1 AND 29
  UNION ALL SELECT doc_id, pos, 'late_page' FROM units WHERE page > 3 UNION ALL SELECT doc_id, pos, 'deep_level' FROM units WHERE level = 5),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id, pos) AS n FROM v)
SELECT rule, count(*) AS violations, list_sort(list(CAST(doc_id AS VARCHAR)) FILTER (n <= 5)) AS examples FROM r GROUP BY rule"""
)
def corpus_audit_rules(spark, sf_dir):
    n = F.length("line")
    rules = {"missing_text": n == 0, "short_text": n.between(1, 29), "late_page": F.col("page") > 3, "deep_level": F.col("level") == 5}
    return ca.rule_audit(units(spark, sf_dir), rules, ["doc_id", "pos"])


@query(
    f"""WITH {UNITS}, ok AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), x AS (SELECT u.*, CASE WHEN level = 1 THEN 'missing_legal_structure' WHEN role = 'primary_regulation' AND doc_id % 3 = 0 THEN 'duplicate_primary_file'
  WHEN level = 2 AND contains(line, '|') THEN 'unreadable_table' WHEN level NOT IN (3, 4, 5) THEN 'not_citation_admitted' END AS reason FROM units u)
SELECT x.doc_id, x.pos, role, t.toxic FROM x JOIN ok USING (doc_id) LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id) WHERE reason IS NULL"""
)
def corpus_build(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    admission = F.when((F.col("level") == 2) & F.contains("line", F.lit("|")), "quarantined_unreadable_table").when(F.col("level").isin(3, 4, 5), "atomic_leaf")
    reason = ci.exclusion_reason(F.col("level") > 1, F.col("role"), ~((F.col("role") == "primary_regulation") & (F.col("doc_id") % 3 == 0)), admission)
    meta = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return ca.build_corpus(units(spark, sf_dir), labels.where("quality = 1"), meta, "doc_id", "pos", "doc_id", reason).select("doc_id", "pos", "role", "toxic")


@query(
    f"""WITH {UNITS}, p AS (SELECT doc_id, page, sum(length(line)) AS n FROM units GROUP BY doc_id, page), d AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (n < 200) AS empty, sum(n) AS chars FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN chars < 100 OR empty / pages > 0.7 THEN 'likely_needs_ocr' ELSE 'extracted_ok' END AS status, CASE WHEN chars < 100 THEN 'document_text_under_100_chars' WHEN empty / pages > 0.7 THEN 'more_than_70_percent_pages_empty' END AS reason FROM d"""
)
def extraction_status(spark, sf_dir):
    pages = units(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("line")).alias("n"))
    d = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") < 200).alias("empty"), F.sum("n").alias("chars"))
    return d.select("doc_id", ci.extraction_status(F.col("pages"), F.col("empty"), F.col("chars")).alias("s")).select("doc_id", "s.status", "s.reason")


@query(
    f"""WITH {UNITS}, f AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS flat, title, page FROM units)
SELECT doc_id, pos, array_to_string(list_filter([CASE WHEN title = '' THEN 'missing_document_title' END, CASE WHEN contains(flat, '|---') THEN 'markdown_table_artifact' END, CASE WHEN length(flat) < 30 THEN 'very_short_text' END,
  CASE WHEN contains(flat, '................') THEN 'form_placeholder_text' END], lambda x: x IS NOT NULL), ',') AS flags, round(CAST(1 AS DOUBLE) * CASE WHEN length(flat) < 30 THEN 0.7 ELSE 1.0 END * CASE WHEN contains(flat, '|---') THEN 0.62 ELSE 1.0 END * CASE WHEN contains(flat, '................') THEN 0.72 ELSE 1.0 END, 6) AS multiplier FROM f"""
)
def issue_flags(spark, sf_dir):
    flags = ci.issue_flags(F.col("title"), F.col("page"), F.col("line"))
    return units(spark, sf_dir).select("doc_id", "pos", F.array_join(flags, ",").alias("flags"), F.round(ci.quality_multiplier(flags, F.lit(False)), 6).alias("multiplier"))


TAB = "string_split(text, chr(10))"


@query(
    r"""WITH d AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')) AS ls FROM documents WHERE contains(text, '|') AND contains(text, chr(10))),
c AS (SELECT doc_id, text, list_transform(ls, lambda l: list_filter(list_transform(string_split(trim(trim(l), '|'), '|'), lambda x: trim(trim(trim(regexp_replace(x, '\s+', ' ', 'g')), ' |'), ' ;')), lambda x: x <> '')) AS rows FROM d),
k AS (SELECT doc_id, list_filter(rows, lambda r: len(r) > 0) AS rows FROM c)
SELECT doc_id, CAST(len(rows) AS INTEGER) AS row_count, CAST(len(flatten(rows)) AS INTEGER) AS nonempty_cell_count, len(rows) < 3 OR len(flatten(rows)) < 4 AS thin FROM k"""
)
def table_readability(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|")) & F.contains("text", F.lit("\n")))
    return d.select("doc_id", tb.readability(F.col("text")).alias("r")).select("doc_id", "r.row_count", "r.nonempty_cell_count", F.array_contains("r.reasons", "insufficient_table_structure").alias("thin"))


def _flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _stripped(x: str, chars: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{chars}]+', ''), '[{chars}]+$', '')"


def _cell(c: str) -> str:
    image = rf"regexp_replace({_flat(c)}, '!\[[^\]]*\]\([^)]+\)', '', 'g')"
    return _stripped(_flat(_stripped(image, r"\s|")), " ;")


def _filled(cells: str) -> str:
    return f"list_filter(list_transform({cells}, lambda c: {_cell('c')}), lambda f: f <> '')"


SEPARATES = "regexp_matches({0}, '^:?-{{3,}}:?$')"
TIDY = ((r"\s+([,.;:])", r"\1"), (r"(?i)([a-z])\.;\s+", r"\1. "), (r"(?i)\b([a-z])\.\s*;\s*", r"\1. "), (r":\s*;", r":"), (r"(?i);\s+(dan|atau);", r"; \1"), (r";\s*;", r";"))


def _tidy(x: str) -> str:
    x = _flat(x)
    for pattern, to in TIDY:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _stripped(_flat(x), " ;")


@query(
    rf"""WITH d AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')), lambda l: {_filled("string_split(" + _stripped("trim(l)", "|") + ", '|')")}) AS many,
  list_transform(string_split(array_to_string(list_transform(string_split(text, '|'), lambda c: coalesce(nullif({_cell('c')}, ''), chr(1))), chr(2)), chr(1)), lambda r: list_filter(string_split(r, chr(2)), lambda y: y <> '')) AS one FROM documents WHERE contains(text, '|')),
k AS (SELECT doc_id, text, list_filter(CASE WHEN contains(text, chr(10)) THEN many ELSE one END, lambda r: len(list_filter(r, lambda y: NOT {SEPARATES.format('y')})) > 0) AS kept FROM d),
r AS (SELECT doc_id, text, list_filter(list_transform(list_transform(kept, lambda r: list_filter(r, lambda y: NOT {SEPARATES.format('y')})), lambda z: {_stripped(_flat(r"CASE WHEN len(z) >= 2 AND regexp_matches(z[1], '(?i)^(\(?[0-9]+[a-z]?\)|[a-z]\.|[ivxlcdm]+\.)$') THEN array_to_string(z, ' ') ELSE array_to_string(z, ' - ') END"), " ;")}), lambda w: w <> '') AS "rows" FROM k),
x AS (SELECT doc_id, CASE WHEN len("rows") = 0 THEN {_flat("text")} ELSE {_stripped(_flat("""array_to_string("rows", '; ')"""), " ;")} END AS text FROM r) SELECT doc_id, {_tidy("text")} AS text FROM x"""
)
def table_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|")))
    return d.select("doc_id", tb.extracted_text(F.col("text"), F.lit("table_or_row")).alias("text"))


@query(
    f"""WITH {UNITS} SELECT doc_id, pos, CASE WHEN title = '' THEN 'missing_document' WHEN level >= 5 THEN 'document_page_pasal_ayat_huruf' WHEN level = 4 THEN 'document_page_pasal_ayat' WHEN level = 3 THEN 'document_page_pasal' WHEN level = 2 THEN 'document_page_section' ELSE 'document_page' END AS quality,
  CASE WHEN title = '' THEN 'Dokumen tidak diketahui' ELSE title END || ', hlm. ' || page || CASE WHEN level >= 3 THEN ', Pasal ' || pos ELSE '' END AS citation, CASE WHEN role IN ('secondary_faq', 'secondary_summary') THEN 'secondary' ELSE 'primary' END AS priority FROM units"""
)
def citation_ladder(spark, sf_dir):
    lv, pos = F.col("level"), F.col("pos").cast("string")
    pasal = F.when(lv >= 3, F.concat(F.lit("Pasal "), pos))
    return units(spark, sf_dir).select(
        "doc_id", "pos", ci.citation_quality(F.col("title"), F.col("page"), pasal, F.when(lv >= 4, "(1)"), F.when(lv >= 5, "huruf a"), F.when(lv == 2, "I")).alias("quality"),
        ci.citation_text(F.col("title"), F.col("page"), pasal).alias("citation"), ci.source_priority(F.col("role")).alias("priority"),
    )
