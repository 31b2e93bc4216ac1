"""Audits, spot checks, scopes, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citation as ci
from ..functions import text as t
from ..operators import audit as au
from ..operators import evaluation as ev
from ..operators import evidence as ed
from .answers import _findings
from .base import DOCS, ORACLE_SQL, UNITS, docs, query, sql_tokens, table, units


@query(
    "SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey % 4 <> 0 AND contains(lower(p_type || chr(10) || p_name), 'an')"
)
def extract_filter(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("file_id"), (F.col("p_size") > 5).alias("exists"), F.when(F.col("p_partkey") % 4 == 0, "sikepo-ojk").otherwise("x").alias("source"), F.col("p_type").alias("path"), F.col("p_name").alias("title")
    )
    return au.wanted_files(f, contains="AN").select(F.col("file_id").cast("long").alias("p_partkey"))


@query(
    f"""WITH {UNITS}, k AS (SELECT doc_id, pos, issuer, CASE doc_id % 4 WHEN 0 THEN 'Peraturan (PBI) ' || lang WHEN 1 THEN 'Pojk ' || lang WHEN 2 THEN lang || '/SEOJK' ELSE 'SK ' || lang END AS kind, nullif(title, '') AS title, nullif(line, '') AS line FROM units)
SELECT doc_id, pos, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title' END, CASE WHEN line IS NULL THEN 'line' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN regexp_matches(kind, 'PBI|PADG') AND issuer <> 'BI' THEN 'BI' WHEN regexp_matches(kind, '(?i)pojk|seojk') AND issuer <> 'OJK' THEN 'OJK' END AS should_be FROM k"""
)
def provenance_audit(spark, sf_dir):
    kind = F.concat(F.element_at(F.array(*map(F.lit, ("Peraturan (PBI) ", "Pojk ", "", "SK "))), (F.col("doc_id") % 4 + 1).cast("int")), F.col("lang"), F.when(F.col("doc_id") % 4 == 2, "/SEOJK").otherwise(""))
    return units(spark, sf_dir).select("doc_id", "pos", F.array_join(au.missing_fields("title", "line"), ",").alias("missing"), au.issuer_mismatch(kind, F.col("issuer")).alias("should_be"))


@query(
    f"""WITH {UNITS} SELECT issuer, count(*) AS "rows", round(avg(CASE WHEN page > 1 THEN 1 ELSE 0 END), 6) AS page_rate, round(avg(CASE WHEN level = 3 THEN 1 ELSE 0 END), 6) AS article_rate,
  avg(CASE WHEN level = 3 THEN 1 ELSE 0 END) < 0.5 AS warned FROM units GROUP BY issuer"""
)
def spot_check_rates(spark, sf_dir):
    r = au.rates(units(spark, sf_dir), {"page_rate": F.col("page") > 1, "article_rate": F.col("level") == 3}, ["issuer"])
    return au.warnings(r, least={"article_rate": 0.5}).select("issuer", "rows", "page_rate", "article_rate", (F.size("warnings") > 0).alias("warned"))


@query(
    f"""WITH {DOCS}, t AS (SELECT unnest(['licence', 'mine', 'other']) AS target, unnest([['license'], ['the ', 'OUWHEA'], ['zu']]) AS patterns, unnest(['BI', NULL, NULL]) AS wanted)
SELECT target, doc_id FROM docs, t WHERE len(list_filter(patterns, lambda p: contains(lower(title), lower(p)))) > 0 AND (wanted IS NULL OR wanted = issuer)"""
)
def spot_check_titles(spark, sf_dir):
    targets = spark.createDataFrame([("licence", ["license"], "BI"), ("mine", ["the ", "OUWHEA"], None), ("other", ["zu"], None)], "target string, patterns array<string>, issuer string")
    return au.by_title(docs(spark, sf_dir).select("doc_id", "title", "issuer"), targets).select("target", "doc_id")


@query(
    f"""WITH {UNITS}, s AS (SELECT doc_id, pos, CASE level WHEN 3 THEN 'pasal' WHEN 4 THEN 'ayat' WHEN 2 THEN 'table' ELSE 'text' END AS section FROM units),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS n FROM s), f AS (SELECT *, CASE WHEN n = 1 AND section = 'pasal' THEN 1 WHEN n = 1 AND section = 'ayat' THEN 2 WHEN n = 1 AND section = 'table' THEN 3 ELSE 4 END AS turn FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, pos) AS place FROM f) SELECT doc_id, pos, section, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5"""
)
def representative_examples(spark, sf_dir):
    section = F.when(F.col("level") == 3, "pasal").when(F.col("level") == 4, "ayat").when(F.col("level") == 2, "table").otherwise("text")
    u = units(spark, sf_dir).select("doc_id", "pos", section.alias("section"))
    return au.examples(u, "section", ["pasal", "ayat", "table"], 5, ["pos"], ["doc_id"])


@query("SELECT event_id, CAST(event_id % 12 AS INTEGER) AS ayat, CAST(1 + event_id % 26 AS INTEGER) AS huruf, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END AS INTEGER) AS angka FROM events")
def legal_order(spark, sf_dir):
    k = F.col("event_id")
    letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (1 + k % 26).cast("int"), F.lit(1))
    key = au.legal_order(F.concat(F.lit("("), (k % 12).cast("string"), F.lit(")")), F.concat(F.lit("huruf "), letter), F.when(k % 2 == 0, (k % 7).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", key.alias("k")).select("event_id", "k.*")


@query(
    f"""WITH p AS (SELECT p_partkey, {sql_tokens("p_name")} AS ph, {sql_tokens("p_type || ' ' || p_brand || ' promo'")} AS q FROM part)
SELECT p_partkey, len(ph) > 0 AND (list_contains(q, array_to_string(list_transform(ph, lambda x: substr(x, 1, 1)), '')) OR len(list_filter(ph, lambda x: len(list_filter(q, lambda y: contains(y, x) OR contains(x, y))) = 0)) = 0) AS anchored FROM p"""
)
def phrase_anchor(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", t.tokens(F.col("p_name")).alias("ph"), t.tokens(F.concat_ws(" ", "p_type", "p_brand", F.lit("promo"))).alias("q"))
    return p.select("p_partkey", au.phrase_anchored(F.col("ph"), F.col("q")).alias("anchored"))


RUNS = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i : i + {1} - 1], ' '))"


@query(
    f"""WITH {DOCS}, d AS (SELECT doc_id, text, {sql_tokens("title")} AS ts, {sql_tokens("text")} AS q FROM docs),
r AS (SELECT doc_id, {RUNS.format("ts", 4)} AS t4, {RUNS.format("ts", 3)} AS t3, {RUNS.format("q", 4)} AS q4, {RUNS.format("q", 3)} AS q3 FROM (SELECT a.doc_id, a.ts, b.q FROM d a JOIN d b ON b.doc_id = a.doc_id - 1)),
s AS (SELECT doc_id, list_concat(list_filter(t4, lambda x, i: list_contains(q4, x) AND list_position(t4, x) = i), list_filter(t3, lambda x, i: list_contains(q3, x) AND list_position(t3, x) = i)) AS runs FROM r),
a AS (SELECT doc_id, list_filter(list_transform(runs, lambda x: regexp_replace(array_to_string(list_transform(string_split(x, ' '), lambda w: substr(w, 1, 1)), ''), '[^a-z]', '', 'g')), lambda x: length(x) >= 3) AS l FROM s)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ' ') AS acronyms FROM a"""
)
def title_acronyms(spark, sf_dir):
    """Initials of the word runs that a document's title shares with the text of the document before it by number."""
    d = docs(spark, sf_dir).select("doc_id", t.tokens(F.col("title")).alias("ts"), t.tokens(F.col("text")).alias("q"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), "q")
    return d.select("doc_id", "ts").join(before, "doc_id").select("doc_id", F.array_join(au.shared_acronyms(F.col("q"), F.col("ts")), " ").alias("acronyms"))


SCOPE = f"""{DOCS}, x AS (SELECT CAST(doc_id % 20 AS BIGINT) AS search_id, doc_id AS file_id, CAST(60 + doc_id % 41 AS DOUBLE) AS title_score, CASE WHEN doc_id % 20 = 7 THEN 'SEOJK' WHEN doc_id % 3 = 0 THEN 'POJK' WHEN doc_id % 3 = 1 THEN 'SEOJK' ELSE 'PBI' END AS kind, list_distinct({sql_tokens("title")}) AS terms FROM docs),
m AS (SELECT *, title_score >= 0.75 * max(title_score) OVER (PARTITION BY search_id) AS near, kind <> 'SEOJK' AS gov FROM x), l AS (SELECT search_id, arg_min(terms, (-title_score, file_id)) AS lead FROM m WHERE near AND gov GROUP BY search_id)"""


@query(
    f"""WITH {SCOPE} SELECT search_id, file_id, title_score FROM m LEFT JOIN l USING (search_id) WHERE CASE WHEN lead IS NULL THEN near ELSE gov AND (near OR len(list_intersect(terms, lead)) / greatest(1, len(list_distinct(list_concat(terms, lead)))) >= 0.7) END"""
)
def focused_scope(spark, sf_dir):
    d = F.col("doc_id")
    x = docs(spark, sf_dir).select(
        (d % 20).alias("search_id"), d.alias("file_id"), (60 + d % 41).cast("double").alias("title_score"), F.when(d % 20 == 7, "SEOJK").when(d % 3 == 0, "POJK").when(d % 3 == 1, "SEOJK").otherwise("PBI").alias("regulation_type"), F.array_distinct(t.tokens(F.col("title"))).alias("terms")
    )
    return au.title_scope(x)


@query(
    f"""WITH {UNITS}, f AS (SELECT doc_id, issuer, CASE level WHEN 5 THEN 'document_page_pasal' ELSE 'document_page' END AS quality, length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) < 30 AS short FROM units WHERE title <> '')
SELECT doc_id, 'quality' AS dimension, quality AS value, count(*) AS n FROM f GROUP BY 1, 3 UNION ALL SELECT doc_id, 'issuer', issuer, count(*) FROM f GROUP BY 1, 3 UNION ALL SELECT doc_id, 'flag', 'very_short_text', count(*) FROM f WHERE short GROUP BY 1"""
)
def trace_profile(spark, sf_dir):
    u = units(spark, sf_dir).where("title <> '' AND NOT contains(line, '|---') AND NOT contains(line, repeat('.', 16)) AND NOT contains(line, '![](')")
    items = u.select("doc_id", "issuer", F.when(F.col("level") == 5, "document_page_pasal").otherwise("document_page").alias("citation_quality"), ci.issue_flags(F.col("title"), F.col("page"), F.col("line")).alias("flags"))
    return ed.trace(items, "doc_id")


def _by_role(found):
    """Up to three findings a question, each citing its document's role."""
    k = F.col("document")
    return found.groupBy("query_id").agg(F.collect_list(F.struct(F.col("place").cast("string").alias("id"), k.alias("citation_id"))).alias("f"), F.collect_list(F.struct(k.alias("id"))).alias("c"))


@query(
    "WITH f AS (" + ORACLE_SQL["select_findings"].replace("doc_id AS block, issuer FROM p", "role FROM p") + ") SELECT query_id, true AS citations_exist, count(DISTINCT role) = count(*) AS citations_unique FROM f GROUP BY query_id"
)
def answer_contract(spark, sf_dir):
    g = _by_role(_findings(spark, sf_dir))
    return g.select("query_id", ev.contract(F.col("f"), F.col("c")).alias("k")).select("query_id", "k.citations_exist", "k.citations_unique")
