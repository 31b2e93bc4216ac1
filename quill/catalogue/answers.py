"""Constraints, gates, evidence, answers, evaluation, lexicon, plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims, legal, scoring
from ..functions import text as t
from ..operators import evaluation as ev
from ..operators import evidence as ed
from ..operators import lexicon as lx
from ..operators import search as se
from ..operators.contain import containing
from .base import BM25, DOCS, ORACLE_SQL, SEARCHES, UNITS, docs, index, query, searches, sql_tokens, table, units

QUESTIONS = """q AS (SELECT o_orderkey AS id, 'Apa isi ' || CASE o_orderkey % 4 WHEN 0 THEN 'Pasal ' || o_custkey || ' ayat (' || (o_orderkey % 9) || ')' WHEN 1 THEN 'pasal ' || o_custkey || 'A (2) huruf ' || chr(97 + CAST(o_orderkey % 26 AS INTEGER))
  WHEN 2 THEN 'POJK Nomor ' || o_custkey || ' Tahun ' || year(o_orderdate) ELSE 'seojk ' || o_custkey || '/SEOJK.03/' || year(o_orderdate) END || '?' AS question FROM orders)"""


def _questions(spark, sf_dir):
    k, c, y = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("Pasal "), c, F.lit(" ayat ("), (k % 9).cast("string"), F.lit(")")))
        .when(k % 4 == 1, F.concat(F.lit("pasal "), c, F.lit("A (2) huruf "), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26 + 1).cast("int"), F.lit(1))))
        .when(k % 4 == 2, F.concat(F.lit("POJK Nomor "), c, F.lit(" Tahun "), y))
        .otherwise(F.concat(F.lit("seojk "), c, F.lit("/SEOJK.03/"), y))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("Apa isi "), body, F.lit("?")).alias("question"), "o_custkey")


@query(
    "WITH " + QUESTIONS + r""" SELECT id, 'Pasal ' || upper(nullif(regexp_extract(question, '(?i)\bpasal\s+([0-9]+[A-Z]?)\b', 1), '')) AS pasal,
  '(' || nullif(coalesce(nullif(regexp_extract(question, '(?i)\bayat\s*\(?\s*([0-9]+[a-z]?)\s*\)?', 1), ''), regexp_extract(question, '(?i)\bpasal\s+[0-9]+[A-Z]?\s*\(\s*([0-9]+[a-z]?)\s*\)', 1)), '') || ')' AS ayat,
  'huruf ' || nullif(regexp_extract(question, '(?i)\bhuruf\s+([a-z])\b', 1), '') AS huruf, upper(nullif(regexp_extract(question, '(?i)\b(PBI|POJK|PADG|SEOJK)\b', 1), '')) AS regulation_type,
  nullif(coalesce(nullif(regexp_extract(question, '(?i)\bpojk nomor\s+([0-9]+)', 1), ''), regexp_extract(question, '(?i)\bseojk ([0-9]+)/', 1)), '') AS regulation_number,
  CASE WHEN regexp_matches(question, '(?i)ojk') THEN nullif(regexp_extract(question, '\b((19|20)[0-9][0-9])\?', 1), '') END AS year FROM q"""
)
def parse_constraints(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", legal.constraints(F.col("question")).alias("c")).select("id", "c.*")


@query(
    "WITH " + QUESTIONS + """ SELECT id FROM q JOIN orders ON id = o_orderkey WHERE CASE id % 4 WHEN 0 THEN o_custkey % 5 <> 0 AND id % 9 = 3 WHEN 2 THEN o_custkey % 2 = 0 ELSE false END"""
)
def constraint_filter(spark, sf_dir):
    """Questions against a row that has their article (but for every fifth customer) and ayat (3), or their instrument (even customers)."""
    q = _questions(spark, sf_dir).withColumn("c", legal.constraints(F.col("question")))
    cust = F.col("o_custkey")
    pasal = F.when(cust % 5 != 0, F.concat(F.lit(" pasal  "), cust.cast("string")))
    rows = legal.path_match(F.col("c"), pasal, F.lit("(3)"), F.lit(None).cast("string"))
    docs_ok = legal.document_match(F.col("c"), F.when(cust % 2 == 0, "Peraturan OJK").otherwise("Peraturan Bank Indonesia"), cust.cast("string"), F.lit("x"), F.col("c.year"))
    return q.where(F.when(F.col("c.pasal").isNotNull(), rows).otherwise(docs_ok)).select("id")


@query(
    "SELECT p_partkey, NOT (p_partkey % 2 = 0 AND regexp_matches(lower(p_type || p_name), 'promo|brass')) AS in_scope FROM part"
)
def sector_scope(spark, sf_dir):
    q = F.when(F.col("p_partkey") % 2 == 0, "aturan bank").otherwise("aturan bank promo")
    return table(spark, sf_dir, "part").select("p_partkey", legal.sector_scope(q, F.concat("p_type", "p_name"), "bank", ["promo", "brass"], "bank indonesia").alias("in_scope"))


ALIGN = (
    BM25.format(filter="true")
    + f""", h AS (SELECT h.search_id, h.doc_id, query || CASE search_id % 3 WHEN 1 THEN ' wajib' ELSE '' END AS question, text, search_id % 3 AS k FROM hits h JOIN docs USING (doc_id) JOIN searches USING (search_id) WHERE matched >= min_match),
w AS (SELECT *, list_distinct(list_filter({sql_tokens("question")}, lambda x: NOT list_contains(['berapa', 'batas', 'wajib', 'apa', 'saja', 'bi', 'status', 'current', 'latest', 'minimum'], x) AND NOT regexp_matches(x, '^[0-9]+([/.][0-9]+)*$'))) AS want, list_distinct({sql_tokens("text")}) AS ev FROM h),
x AS (SELECT search_id, doc_id, len(want) AS n, len(list_intersect(want, ev)) AS h, k, lower(text) AS c FROM w)"""
)


@query(
    f"WITH {ALIGN} SELECT search_id, doc_id, round(CASE WHEN n = 0 THEN 1.0 ELSE h / n END, 3) AS ratio, (n = 0 OR h >= greatest(1, ceil(n * 0.75))) AND (k <> 1 OR regexp_matches(c, 'wajib|harus|dilarang|berkewajiban|dengan memperhatikan ketentuan')) AS accepted FROM x"
)
def alignment_gate(spark, sf_dir):
    """Every hit of every search against its question; every third question asks for an obligation."""
    s = searches(spark, sf_dir)
    hits = se.bm25(index(spark, sf_dir), s).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    q = s.select("search_id", F.concat("query", F.when(F.col("search_id") % 3 == 1, " wajib").otherwise("")).alias("question"))
    pairs = hits.join(se.side(q), "search_id")
    a = legal.alignment(F.col("question"), F.lit(""), F.col("text"))
    return pairs.select("search_id", "doc_id", a.alias("a")).select("search_id", "doc_id", F.col("a.distinctive_ratio").alias("ratio"), "a.accepted")


@query(
    r"""WITH x AS (SELECT event_id, lower(event_type || ' ' || CASE event_id % 4 WHEN 0 THEN 'sebesar Rp' || CAST(floor(value) AS INTEGER) || ' juta' WHEN 1 THEN 'Lembaran Negara' WHEN 2 THEN 'dilarang untuk 3 hari' ELSE 'Menimbang : bahwa' END) AS c, value FROM events)
SELECT event_id, event_id % 4 = 2 OR (event_id % 4 = 0 AND value >= 10) AS has_value, CASE event_id % 4 WHEN 1 THEN 'promulgation' WHEN 3 THEN 'consideration' ELSE 'substantive' END AS category, CAST(CASE event_id % 4 WHEN 1 THEN -120 WHEN 3 THEN -100 ELSE 0 END AS DOUBLE) AS penalty FROM x"""
)
def noise_classify(spark, sf_dir):
    k = F.col("event_id") % 4
    c = F.concat("event_type", F.lit(" "), F.when(k == 0, F.concat(F.lit("sebesar Rp"), F.col("value").cast("int").cast("string"), F.lit(" juta"))).when(k == 1, "Lembaran Negara").when(k == 2, "dilarang untuk 3 hari").otherwise("Menimbang : bahwa"))
    return table(spark, sf_dir, "events").select("event_id", legal.value_matches(c).alias("has_value"), claims.noise_category(c).alias("category"), claims.noise_penalty(F.lit("apa"), claims.noise_category(c)).alias("penalty"))


@query(
    f"""WITH {UNITS}, c AS (SELECT issuer, role, CASE WHEN regexp_matches(line, '(?i)license') THEN 'license' WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS category FROM units)
SELECT category, 'issuer' AS dimension, issuer AS value, count(*) AS n FROM c GROUP BY 1, 3 UNION ALL SELECT category, 'role', role, count(*) FROM c GROUP BY 1, 3"""
)
def noise_profile(spark, sf_dir):
    category = F.when(F.col("line").rlike("(?i)license"), "license").when(F.contains("line", F.lit("|")), "table").otherwise("text")
    u = units(spark, sf_dir).select(category.alias("category"), "issuer", "role")
    one = u.select("category", F.explode(F.array(F.struct(F.lit("issuer").alias("dimension"), F.col("issuer").alias("value")), F.struct(F.lit("role").alias("dimension"), F.col("role").alias("value")))).alias("x"))
    return one.groupBy("category", "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


SUPPORT = (
    BM25.format(filter="true")
    + f""", h AS (SELECT search_id, h.doc_id, round(bm25, 6) AS bm25, title, text, docs.issuer, role, {sql_tokens("query")} AS qt FROM hits h JOIN docs USING (doc_id) JOIN searches USING (search_id) WHERE matched >= min_match),
o AS (SELECT *, len(list_intersect(qt, {sql_tokens("title")})) AS a, len({sql_tokens("title")}) AS la, len(list_intersect(qt, {sql_tokens("substr(text, 1, 1000)")})) AS b, len({sql_tokens("substr(text, 1, 1000)")}) AS lb FROM h),
s AS (SELECT *, CASE WHEN la = 0 THEN 0 ELSE a + least(0.5, la * 0.03) END AS ta, CASE WHEN lb = 0 THEN 0 ELSE b + least(0.5, lb * 0.03) END AS tb FROM o),
items AS (SELECT search_id, doc_id, issuer, role, title, bm25, least(1.0, CAST(0.16 * ta + 0.10 * tb AS DOUBLE)) AS lexical FROM s)"""
)


def _items(spark, sf_dir):
    d, s = docs(spark, sf_dir), searches(spark, sf_dir)
    read = d.select("doc_id", "title", "text", "issuer", "role", t.tokens(F.col("title")).alias("title_terms"), t.tokens(F.substring("text", 1, 1000)).alias("text_terms"))  # once a document, not once a hit
    asked = s.select("search_id", t.tokens(F.col("query")).alias("query_terms"))
    hits = se.bm25(index(spark, sf_dir), s).withColumn("bm25", F.round("bm25", 6)).join(read, "doc_id").join(se.side(asked), "search_id")
    qt = F.col("query_terms")
    lexical = scoring.lexical_support(t.overlap_score(qt, F.col("title_terms")), t.overlap_score(qt, F.col("text_terms")), F.lit(0))
    return hits.withColumn("lexical", lexical)


@query(f"WITH {SUPPORT} SELECT search_id, doc_id, round(lexical, 6) AS lexical, round(bm25 * (0.75 + lexical), 10) AS support FROM items")
def evidence_support(spark, sf_dir):
    support = scoring.support_score(F.col("bm25"), F.col("lexical"), F.lit(1.0), F.lit(0))
    return _items(spark, sf_dir).select("search_id", "doc_id", F.round("lexical", 6).alias("lexical"), F.round(support, 10).alias("support"))


@query(
    f"""WITH {SUPPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id, issuer, role ORDER BY bm25 DESC, doc_id) AS n FROM items)
SELECT search_id, issuer, role, max(bm25) AS best, count(*) AS n, array_to_string(list(doc_id ORDER BY n), ',') AS items FROM r WHERE n <= 3 GROUP BY search_id, issuer, role"""
)
def evidence_group_topk(spark, sf_dir):
    out = ed.group_top(_items(spark, sf_dir), ["issuer", "role"], 3, "bm25", "doc_id", by="search_id")
    return out.select("search_id", "issuer", "role", "best", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(
    f"""WITH {SUPPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY bm25 DESC, doc_id) AS n FROM items),
g AS (SELECT search_id, avg(CASE WHEN role IN ('secondary_faq', 'secondary_summary') THEN 0 ELSE 1 END) AS p, avg(CASE WHEN title <> '' THEN 1 ELSE 0 END) AS a, avg(lexical) AS l, max(CASE WHEN issuer = 'BI' THEN 1 ELSE 0 END) AS i FROM r WHERE n <= 5 GROUP BY search_id),
sc AS (SELECT *, CAST(0.25 * p + 0.20 + 0.15 * a + 0.15 * l + 0.10 * 0.8 + 0.05 * i AS DOUBLE) AS score FROM g),
w AS (SELECT *, CASE WHEN search_id % 2 = 1 AND l < 0.55 THEN 'weak' WHEN score >= 0.78 THEN 'strong' WHEN score >= 0.55 THEN 'partial' ELSE 'weak' END AS w FROM sc)
SELECT search_id, round(least(1.0, score), 6) AS score, CASE WHEN w = 'weak' AND score >= 0.70 AND search_id % 2 = 0 THEN 'partial' ELSE w END AS label FROM w"""
)
def confidence_label(spark, sf_dir):
    items = _items(spark, sf_dir).select(
        "search_id", "doc_id", "bm25", (~F.col("role").isin(*se.SECONDARY)).alias("is_primary"), F.lit(True).alias("has_page"), (F.col("title") != "").alias("has_article"), F.col("lexical").alias("lexical_support"),
        F.lit(0).alias("phrases"), F.lit(0.8).alias("coverage"), (F.col("issuer") == "BI").alias("issuer_hit"), F.lit(False).alias("ambiguous"), F.lit(False).alias("exact_support"), (F.col("search_id") % 2 == 0).alias("has_topic"),
    )
    return ed.confidence(items, "search_id", order=[F.desc("bm25"), F.col("doc_id")]).select("search_id", "score", "label")


@query(
    f"""WITH {SUPPORT}, seen AS (SELECT search_id, issuer, bool_or(role = 'primary_regulation') AS d, bool_or(role <> 'primary_regulation') AS a FROM items GROUP BY search_id, issuer),
e AS (SELECT search_id, issuer FROM (SELECT item_id AS search_id FROM benchmark), (SELECT unnest(['BI', 'OJK']) AS issuer))
SELECT search_id, issuer, CASE WHEN d THEN 'direct' WHEN a THEN 'adjacent_only' ELSE 'missing' END AS label FROM e LEFT JOIN seen USING (search_id, issuer)"""
)
def cross_source_coverage(spark, sf_dir):
    items = _items(spark, sf_dir).select("search_id", "issuer", (F.col("role") == "primary_regulation").alias("direct"), (F.col("role") != "primary_regulation").alias("adjacent"))
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.explode(F.array(F.lit("BI"), F.lit("OJK"))).alias("issuer"))
    return ed.issuer_coverage(items, expected, "search_id")


CLAIMS = f"""{UNITS}, k AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS c FROM units)"""


@query(
    f"""WITH {CLAIMS} SELECT doc_id, pos, length(line) >= 30 AND NOT regexp_matches(line, '^[A-Z\\s/.\\-0-9()]{{40,}}$') AND NOT regexp_matches(lower(line), '^(paragraf|menimbang)') AS usable,
  c <> '' AND NOT regexp_matches(c, '([:;]|dan/atau)$') AS complete FROM k"""
)
def claim_filters(spark, sf_dir):
    none = F.array().cast("array<string>")
    return units(spark, sf_dir).select("doc_id", "pos", claims.usable(F.lit("apa"), F.col("line"), F.lit("ayat"), none).alias("usable"), claims.complete(F.col("line")).alias("complete"))


@query(
    f"""WITH {UNITS}, q AS (SELECT {sql_tokens("'the of and reading shed license wajib'")} AS qt), c AS (SELECT doc_id, pos, line, level, {sql_tokens("line")} AS ct FROM units)
SELECT doc_id, pos, round(10.0 + 12.0 * len(list_intersect(qt, ct)) / len(qt) + CASE WHEN regexp_matches(lower(line), 'wajib|harus|dilarang|pelapor adalah') THEN 14 ELSE 0 END + CASE WHEN level = 3 THEN 4 ELSE 0 END + 18.0, 5) AS score FROM c, q"""
)
def answer_rank(spark, sf_dir):
    question = F.lit("the of and reading shed license wajib")
    u = units(spark, sf_dir)
    score = claims.rank(
        question, t.tokens(question), F.col("line"), t.tokens(F.col("line")), F.lit(10.0), F.when(F.col("level") == 3, "pasal").otherwise("bab"), F.lit("document_page"), F.lit("POJK"), F.lit(""), F.array().cast("array<string>")
    )
    return u.select("doc_id", "pos", F.round(score, 5).alias("score"))


def _findings(spark, sf_dir):
    items = _items(spark, sf_dir).select(
        F.col("search_id").alias("query_id"), F.col("bm25").alias("rank"), (F.length("text") > 60).alias("usable"), "issuer", (F.col("issuer") == "OJK").alias("required"), F.col("role").alias("document"), F.col("title").alias("citation"),
        F.lit(0.5).alias("title_overlap"), F.col("doc_id").alias("block"), claims.claim_text(F.col("text"), F.lit(False)).alias("claim"),
    )
    return ed.select_findings(items)


@query(
    f"""WITH {SUPPORT}, u AS (SELECT i.*, length(text) > 60 AS usable FROM items i JOIN docs USING (doc_id)), once AS (SELECT *, row_number() OVER (PARTITION BY search_id, title ORDER BY bm25 DESC, doc_id) AS c FROM u WHERE usable),
l AS (SELECT *, CASE WHEN issuer = 'OJK' AND row_number() OVER (PARTITION BY search_id, issuer ORDER BY bm25 DESC, doc_id) = 1 THEN 0 ELSE 1 END AS late FROM once WHERE c = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY search_id, role ORDER BY late, bm25 DESC, doc_id) AS d FROM l), p AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY late, bm25 DESC, doc_id) AS place FROM d WHERE d <= 3)
SELECT search_id AS query_id, CAST(place AS INTEGER) AS place, doc_id AS block, issuer FROM p WHERE place <= 3"""
)
def select_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("query_id", "place", "block", "issuer")


CLAIM = r"""v AS (SELECT doc_id, trim(regexp_replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^\.\.\.', ' ', 'g'), '\.\.\.$', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\|[-:\s|]+\|', ' ', 'g'), '^#+\s*', ' ', 'g')), '|', '; '), '\s+', ' ', 'g')) AS v FROM docs),
h AS (SELECT *, substr(v, 1, 420) AS h FROM v), c AS (SELECT *, regexp_extract(h, '^(.*[.;])\s', 1) AS s, regexp_extract(h, '^(.*)\s', 1) AS b FROM h),
claims AS (SELECT doc_id, CASE WHEN length(v) <= 420 THEN v ELSE rtrim(CASE WHEN length(s) >= 180 THEN s WHEN length(b) >= 180 THEN b ELSE h END) END AS claim FROM c)"""


@query(f"WITH {DOCS}, {CLAIM} SELECT doc_id, claim FROM claims")
def claim_texts(spark, sf_dir):
    """Documents' texts as claims: cleaned, and cut at the end of a sentence or at a blank."""
    return docs(spark, sf_dir).select("doc_id", claims.claim_text(F.col("text"), F.lit(False)).alias("claim"))


@query(
    f"""WITH {DOCS}, {CLAIM}, f AS ({ORACLE_SQL["select_findings"].replace("doc_id AS block, issuer FROM p", "doc_id AS block, role FROM p")}), sure AS ({ORACLE_SQL["confidence_label"]}),
g AS (SELECT query_id, string_agg('f' || place || ' c' || place || ' ' || block || ' ' || claim, chr(10) ORDER BY place) AS findings, arg_min(role, place) AS document FROM f JOIN claims ON doc_id = block GROUP BY query_id),
q AS (SELECT item_id AS query_id, label FROM benchmark LEFT JOIN sure ON search_id = item_id),
s AS (SELECT query_id, CASE WHEN findings IS NULL OR label IS NULL OR label = 'weak' THEN 'not_found' WHEN label = 'partial' THEN 'partial' ELSE 'answerable' END AS status, findings, document FROM q LEFT JOIN g USING (query_id))
SELECT query_id, status, CASE WHEN status = 'not_found' THEN 'Tidak ditemukan dalam dokumen yang tersedia.' ELSE 'Ketentuan yang paling relevan ditemukan dalam ' || document || '.' END AS summary, CASE WHEN status = 'not_found' THEN '' ELSE findings END AS findings FROM s"""
)
def compose_answer(spark, sf_dir):
    """A template answer for each search, from its findings."""
    labels = confidence_label(spark, sf_dir).select(F.col("search_id").alias("query_id"), "label", (F.col("label") == "weak").alias("must_say_not_found"), F.lit(None).cast("string").alias("ambiguity"))
    every = searches(spark, sf_dir).select(F.col("search_id").alias("query_id")).join(labels, "query_id", "left").fillna({"label": "not_found", "must_say_not_found": True})
    out = ed.answers(_findings(spark, sf_dir), every)
    line = F.transform("findings", lambda x: F.concat_ws(" ", x["id"], x["citation_id"], x["block"].cast("string"), x["text"]))
    return out.select("query_id", "status", "summary", F.array_join(line, "\n").alias("findings"))


TARGETS = (
    DOCS
    + ", v AS (SELECT item_id, text AS needle, CAST(1 + item_id % 3 AS INTEGER) AS target_start, CAST(1 + item_id % 3 + item_id % 2 AS INTEGER) AS target_end FROM benchmark), "
    "c AS (SELECT doc_id, text, CAST(1 + doc_id % 4 AS INTEGER) AS page_start, CAST(1 + doc_id % 4 + doc_id % 2 AS INTEGER) AS page_end FROM docs), "
    "m AS (SELECT item_id, doc_id FROM v JOIN c ON page_end >= target_start AND page_start <= target_end AND contains(lower(text), lower(needle)))"
)


def _targets(spark, sf_dir):
    """A target variant for each test item and document that has its text, by the item's page range; a citation for each document."""
    i, d = F.col("item_id"), F.col("doc_id")
    v = table(spark, sf_dir, "benchmark").select("item_id", (1 + i % 3).cast("int").alias("target_start"), (1 + i % 3 + i % 2).cast("int").alias("target_end"), F.col("text").alias("needle"))
    c = docs(spark, sf_dir).select("doc_id", "issuer", "text", (1 + d % 4).cast("int").alias("page_start"), (1 + d % 4 + d % 2).cast("int").alias("page_end"))
    held = containing(c, v, "doc_id", "item_id", fold_case=True)
    variants = held.select("item_id", "doc_id", "target_start", "target_end", F.array("needle").alias("text_terms"))
    return v, ev.target_matches(c, variants, keys=("doc_id",))


@query(f"WITH {TARGETS} SELECT item_id, doc_id FROM m")
def golden_target_match(spark, sf_dir):
    return _targets(spark, sf_dir)[1].select("item_id", "doc_id")


@query(f"WITH {TARGETS} SELECT item_id FROM v WHERE item_id NOT IN (SELECT item_id FROM m)")
def preflight_missing(spark, sf_dir):
    v, m = _targets(spark, sf_dir)
    return ev.missing_targets(v, m, ["item_id"]).select("item_id")


CHECKED = "SELECT doc_id, quality = 1 AS status, toxic = 0 AS answer_terms, doc_id % 3 > 0 AS exact_targets, doc_id % 5 > 0 AS provenance FROM labels"


@query(
    f"""WITH c AS ({CHECKED}) SELECT doc_id, round(CAST(CASE WHEN status THEN 0.3 ELSE 0 END + CASE WHEN answer_terms THEN 0.2 ELSE 0 END + CASE WHEN exact_targets THEN 0.4 ELSE 0 END + CASE WHEN provenance THEN 0.1 ELSE 0 END AS DOUBLE), 3) AS score,
  status AND answer_terms AND exact_targets AND provenance AS accepted FROM c"""
)
def weighted_checks(spark, sf_dir):
    c = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("status"), (F.col("toxic") == 0).alias("answer_terms"), (F.col("doc_id") % 3 > 0).alias("exact_targets"), (F.col("doc_id") % 5 > 0).alias("provenance"))
    return ev.weighted_checks(c, {"status": 0.3, "answer_terms": 0.2, "exact_targets": 0.4, "provenance": 0.1}).select("doc_id", "score", "accepted")


@query(
    f"""WITH {BM25.format(filter="true")}, r AS (SELECT search_id, doc_id, row_number() OVER (PARTITION BY search_id ORDER BY round(bm25, 6) DESC, doc_id) AS rk FROM hits WHERE matched >= min_match),
rel AS (SELECT item_id AS search_id, d.doc_id FROM benchmark b JOIN docs d ON contains(d.text, b.text)), g AS (SELECT search_id, count(*) AS h, min(rk) AS f, sum(1.0 / log2(rk + 1)) AS dcg FROM r JOIN rel USING (search_id, doc_id) WHERE rk <= 10 GROUP BY search_id),
n AS (SELECT search_id, count(*) AS n FROM rel GROUP BY search_id), i AS (SELECT search_id, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1.0 / log2(k + 1))) AS idcg FROM n)
SELECT search_id, round(coalesce(h, 0) / n, 6) AS recall, round(coalesce(1.0 / f, 0), 6) AS rr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM i LEFT JOIN g USING (search_id)"""
)
def eval_recall_mrr_ndcg(spark, sf_dir):
    """Search by a test item's words; relevant are the documents that have the whole item."""
    d, s = docs(spark, sf_dir), searches(spark, sf_dir)
    found = se.bm25(index(spark, sf_dir), s, limit=10)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.col("text").alias("needle"))
    rel = containing(d, items, "doc_id", "search_id").select("search_id", "doc_id")
    out = ev.ranked(found, rel, "search_id", "doc_id", "rank")
    return out.select("search_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return ev.latencies(table(spark, sf_dir, "events"), "value", ["event_type"])


DELTA = "SELECT event_type AS metric, count(*) AS value FROM events WHERE {0} GROUP BY event_type"


@query(
    f"WITH c AS ({DELTA.format('value > 50')}), p AS ({DELTA.format('value <= 50 AND event_type <> ' + chr(39) + 'click' + chr(39))}) SELECT metric, c.value AS current, p.value AS prior, coalesce(c.value, 0) - coalesce(p.value, 0) AS delta FROM c FULL OUTER JOIN p USING (metric)"
)
def summary_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("metric", F.col("event_type"))

    def counted(where):
        return e.where(where).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))

    return ev.deltas(counted("value > 50"), counted("value <= 50 AND event_type <> 'click'"))


MENTIONS = f"""{DOCS}, m AS (SELECT title AS phrase, issuer, role, 'title' AS origin FROM docs UNION ALL SELECT unnest(string_split(text, chr(10))[2:]), issuer, role, 'heading' FROM docs),
v AS (SELECT * FROM m WHERE length(phrase) BETWEEN 3 AND 160 AND NOT regexp_matches(phrase, '[|#!]|---|\\*\\*|\\*\\)|\\[\\]\\(') AND len({sql_tokens('phrase')}) BETWEEN 1 AND 10),
g AS (SELECT lower(phrase) AS key, sum(CASE origin WHEN 'title' THEN 8.0 ELSE 2.0 END) AS s, count(*) AS support, count(DISTINCT issuer) AS ni, max(CASE WHEN role = 'primary_regulation' THEN 1 ELSE 0 END) AS p, min(CASE WHEN origin = 'heading' THEN 1 ELSE 0 END) AS h FROM v GROUP BY lower(phrase)),
c AS (SELECT key, round(CAST(s * CASE WHEN h = 1 THEN 0.1 ELSE 1.0 END + 2.0 * p + least(2.0, ni) AS DOUBLE), 6) AS score, support, h = 1 AS heading_only FROM g)"""


def _mentions(spark, sf_dir):
    d = docs(spark, sf_dir)
    lines = F.split("text", "\n")
    titles = d.select(F.col("title").alias("phrase"), "issuer", "role", F.lit("title").alias("origin"))
    heads = d.select(F.explode(F.slice(lines, 2, F.size(lines))).alias("phrase"), "issuer", "role", F.lit("heading").alias("origin"))
    return titles.union(heads).where(lx.valid_phrase(F.col("phrase"))).withColumn("type", F.lit("topic"))


@query(f"WITH {MENTIONS} SELECT key, score, support, CASE WHEN score >= 16 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM c")
def lexicon_candidates(spark, sf_dir):
    return lx.candidates(_mentions(spark, sf_dir)).select("key", F.round("score", 6).alias("score"), "support", "confidence")


@query(f"WITH {MENTIONS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS place FROM c WHERE score >= 5 AND support >= 1 AND NOT heading_only) SELECT key, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 50")
def lexicon_generated(spark, sf_dir):
    return lx.generated(lx.candidates(_mentions(spark, sf_dir)), 5.0, 1, 50).select("key", F.round("score", 6).alias("score"), "place")


@query(
    "WITH b AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size <= 10), r AS (SELECT DISTINCT p_brand AS name, lower(p_brand) AS pat FROM part WHERE p_size > 40) "
    "SELECT name FROM b UNION ALL SELECT name FROM r WHERE name NOT IN (SELECT name FROM b)"
)
def lexicon_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entry = [F.lit("entities").alias("section"), F.col("p_brand").alias("name"), F.array(F.lower("p_brand")).alias("patterns")]
    base = p.where("p_size <= 10").select(*entry).distinct()
    reviewed = p.where("p_size > 10").select(*entry, (F.col("p_size") > 40).alias("approved")).distinct()
    return lx.merge(base, reviewed).select("name")


@query(
    f"""WITH l AS (SELECT unnest(['license', 'of', 'the th', 'zu', 'mail']) AS pattern), c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, pattern FROM c, l WHERE CASE WHEN length(pattern) <= 3 THEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || pattern || '([^\\p{{L}}\\p{{N}}_]|$)') ELSE contains(t, pattern) END"""
)
def lexicon_match(spark, sf_dir):
    """Turns against lexicon patterns: short words alone, others anywhere."""
    patterns = ["license", "of", "the th", "zu", "mail"]
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    hits = F.array_compact(F.array(*[F.when(t.contains_pattern(F.col("text"), p), p) for p in patterns]))
    return c.select("conv_id", "turn", F.explode(hits).alias("pattern"))


LEXICON = {
    "intents": [{"intent": "obligations", "patterns": ["wajib", "kewajiban"]}, {"intent": "sanctions", "patterns": ["sanksi"]}],
    "issuers": [{"issuer": "OJK", "patterns": ["ojk"]}, {"issuer": "BI", "patterns": ["bank indonesia"]}],
    "entities": [{"name": "reader", "patterns": ["the"], "expansions": ["the reading of the"], "exact_phrases": []}],
    "topics": [{"name": "copies", "patterns": ["license", "ou"], "expansions": ["released under the license", "ouwhea the of rend"], "issuer": "BI"}],
}
