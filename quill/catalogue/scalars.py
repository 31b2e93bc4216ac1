"""Single functions over columns: what a question asks for, multipliers, keys, phrases, labels. Cases come from a table's key,
and the SQL states what each case gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims, legal, scoring, tables
from ..functions import text as t
from ..operators import evaluation as ev
from ..operators import evidence as ed
from ..operators import geometry as geo
from ..operators import index as ix
from ..operators import lexicon as lx
from ..operators import quality as qu
from ..operators import search as se
from ..operators import units as un
from ..sources import files
from .answers import ALIGN, CHECKED
from .base import BM25, DOCS, UNITS, docs, index, pick, query, searches, sql_tokens, table, units


ASKED = (
    "berapa batas kredit", "modal minimum bank", "minimum modal disetor", "apa syarat izin usaha", "apakah perizinan perlu", "apakah aturan ini masih berlaku", "status peraturan terbaru", "isi tabel kolom",
    "apa sanksi dan kapan berlaku", "psps serta pspk", "klausula eksonerasi", "memberikan data kepada pihak lain", "data kepada pihak lain",
)


@query(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 13 AS q, o_orderkey % 5 AS c, o_custkey % 2 = 1 AS ambiguous FROM orders)
SELECT o_orderkey, q <= 2 AS asks_value, q = 3 AS asks_anchor, q <> 3 OR c = 0 AS anchor_ok, q IN (5, 6) AS lifecycle, q = 7 AS tables, q IN (8, 9, 10, 11) AS compound,
  CAST(CASE WHEN ambiguous OR q IN (8, 9, 10, 11) THEN 0.25 ELSE 0.75 END AS DOUBLE) AS ratio FROM k"""
)
def question_gates(spark, sf_dir):
    """What a question asks for: a value, a licence, a status, tables, two rules at once; and how much of it a claim must have."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", pick(k, *ASKED).alias("q"), pick(k, "izin wajib diperoleh", "perizinan", "persetujuan bank", "nilai Rp5 juta", "-").alias("c"), F.when(F.col("o_custkey") % 2 == 1, "bank_type").alias("ambiguity"))
    q = F.col("q")
    asked, ok = legal.legal_anchor(q, F.col("c"))
    return o.select(
        "o_orderkey", legal.value_required(q).alias("asks_value"), (F.size(asked) > 0).alias("asks_anchor"), ok.alias("anchor_ok"), legal.is_lifecycle_question(q).alias("lifecycle"),
        q.rlike(claims.TABLE_WORDS).alias("tables"), legal.wants_compound(q).alias("compound"), legal.alignment_ratio(q, F.col("ambiguity")).alias("ratio"),
    )


@query(
    "SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 3 = 1 AS said FROM orders"
)
def lifecycle_provenance(spark, sf_dir):
    """Whether a field on a document's life says anything; 'unknown' and empty lists don't."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", pick(k, "active", "unknown", "", None).alias("a"), pick(k, "[]", "amended", None).alias("b"))
    return o.select("o_orderkey", legal.has_lifecycle(F.col("a"), F.col("b")).alias("said"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'promulgation' WHEN 1 THEN 'consideration' WHEN 2 THEN 'enactment' ELSE 'substantive' END AS category,
  event_id % 4 = 3 OR (event_id % 4 = 0 AND event_id % 3 = 0) OR (event_id % 4 = 1 AND event_id % 3 = 1) AS allowed FROM events"""
)
def noise_allowed(spark, sf_dir):
    """Boilerplate may be an answer where the question names its kind."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", pick(k, "Diundangkan di Jakarta", "Menimbang : bahwa", "MEMUTUSKAN : menetapkan", "pihak wajib melapor").alias("c"), pick(k, "kapan diundangkan", "apa latar belakang penerbitan", "apa isi").alias("q"))
    category = claims.noise_category(F.col("c"))
    return e.select("event_id", category.alias("category"), claims.noise_allowed(F.col("q"), category).alias("allowed"))


@query(
    f"""WITH {ALIGN.replace(sql_tokens("text") + ") AS ev", sql_tokens("title") + ") AS ev").replace("text, search_id % 3 AS k", "title, search_id % 3 AS k").replace("lower(text) AS c", "lower(title) AS c, title AS line")}
SELECT search_id, doc_id, (n = 0 OR h >= greatest(1, ceil(n * 0.75))) AND (k <> 1 OR regexp_matches(c, 'wajib|harus|dilarang|berkewajiban|dengan memperhatikan ketentuan'))
  AND length(line) >= 30 AND NOT regexp_matches(line, '^[A-Z\\s/.\\-0-9()]{{40,}}$') AND trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' AND NOT regexp_matches(trim(regexp_replace(line, '\\s+', ' ', 'g')), '([:;]|dan/atau)$') AS usable FROM x"""
)
def usable_rows(spark, sf_dir):
    """Rows whose title line may answer: it fits the question, is usable by its form, and is a complete sentence."""
    s = searches(spark, sf_dir)
    hits = se.bm25(index(spark, sf_dir), s).join(docs(spark, sf_dir).select("doc_id", "title"), "doc_id")
    q = s.select("search_id", F.concat("query", F.when(F.col("search_id") % 3 == 1, " wajib").otherwise("")).alias("question"))
    x = hits.join(se.side(q), "search_id")
    fits = legal.alignment(F.col("question"), F.lit(""), F.col("title"))["accepted"]
    form = claims.usable(F.col("question"), F.col("title"), F.lit("ayat"), F.array().cast("array<string>"))
    return x.select("search_id", "doc_id", (fits & form & claims.complete(F.col("title"))).alias("usable"))


@query(f"WITH {UNITS} SELECT doc_id, pos, length(line) - length(replace(line, '|', '')) >= 2 AS is_table, doc_id % 4 IN (0, 1) AS is_outline FROM units")
def table_lines(spark, sf_dir):
    """Lines of tables, and documents whose kind has the outline grammar."""
    kind = pick(F.col("doc_id"), "SEOJK", "Surat Edaran OJK", "POJK", None)
    return units(spark, sf_dir).select("doc_id", "pos", tables.is_table_line(F.col("line")).alias("is_table"), legal.is_outline_kind(kind).alias("is_outline"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity <= 25 AND l_partkey % 3 > 0 AND l_linenumber <= 5 AS provenance FROM lineitem"""
)
def provenance_valid(spark, sf_dir):
    """A citation with its ids, sources and a page range that begins before it ends."""
    ln = table(spark, sf_dir, "lineitem")
    sources = F.when(F.col("l_partkey") % 3 > 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    ok = ev.has_provenance(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), sources, F.col("l_linenumber"), F.when(F.col("l_quantity") <= 25, F.lit(5)).otherwise(F.lit(0)))
    return ln.select("l_orderkey", "l_linenumber", ok.alias("provenance"))


@query(
    f"""WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN level = 5 THEN 0 ELSE 1 END, page, length(line), pos) AS rk FROM units) SELECT doc_id, pos FROM r WHERE rk = 1"""
)
def representatives_upsert(spark, sf_dir):
    """Representatives of the odd lines, then of the even ones: the better of both stays."""
    u = units(spark, sf_dir).select("doc_id", "pos", "line", "page", F.when(F.col("level") == 5, "enumeration_aggregate").alias("admission"))

    def best(rows):
        rank = ix.representative_rank(F.col("admission"), F.lit(None).cast("string"), F.col("page"), F.lit(None).cast("string"), F.col("line"))
        return ix.representatives(rows, ["doc_id"], rank, "pos")

    return best(best(u.where("pos % 2 = 1")).unionByName(best(u.where("pos % 2 = 0")))).select("doc_id", "pos")


@query(
    f"""WITH c AS ({CHECKED}), s AS (SELECT *, doc_id % 4 AS category, round(CAST(CASE WHEN status THEN 0.3 ELSE 0 END + CASE WHEN answer_terms THEN 0.2 ELSE 0 END + CASE WHEN exact_targets THEN 0.4 ELSE 0 END + CASE WHEN provenance THEN 0.1 ELSE 0 END AS DOUBLE), 3) AS score,
  status AND answer_terms AND exact_targets AND provenance AS ok FROM c)
SELECT category, count(*) FILTER (ok) AS accepted, count(*) AS total, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 3) AS acceptance_rate, round(avg(score), 3) AS average_score FROM s GROUP BY category"""
)
def evaluation_summary(spark, sf_dir):
    c = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 4).alias("category"), (F.col("quality") == 1).alias("status"), (F.col("toxic") == 0).alias("answer_terms"), (F.col("doc_id") % 3 > 0).alias("exact_targets"), (F.col("doc_id") % 5 > 0).alias("provenance"))
    return ev.summary(ev.weighted_checks(c, {"status": 0.3, "answer_terms": 0.2, "exact_targets": 0.4, "provenance": 0.1}), ["category"])


GOLD = ("status", "answer_terms", "exact_targets", "citation_precision", "provenance", "required_issuers", "citation_count", "uncertainty", "forbidden_terms")


@query(
    """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 > 0 AS status, o_orderkey % 3 > 0 AS answer_terms, o_orderkey % 5 > 0 AS exact_targets, (o_orderkey % 4) / 3.0 >= 0.67 AS citation_precision, o_orderkey % 7 > 0 AS provenance, o_orderkey % 11 > 0 AS required_issuers,
  o_orderkey % 13 > 0 AS citation_count, o_orderkey % 17 > 0 AS uncertainty, o_orderkey % 19 > 0 AS forbidden_terms FROM orders),
s AS (SELECT *, round(CAST(0.15 * status::INT + 0.15 * answer_terms::INT + 0.30 * exact_targets::INT + 0.15 * citation_precision::INT + 0.10 * provenance::INT + 0.05 * required_issuers::INT + 0.05 * citation_count::INT + 0.03 * uncertainty::INT + 0.02 * forbidden_terms::INT AS DOUBLE), 3) AS score,
  status AND answer_terms AND exact_targets AND citation_precision AND provenance AND required_issuers AS hard FROM c)
SELECT k, score, score >= 0.9 AND hard AS accepted FROM s"""
)
def golden_checks(spark, sf_dir):
    """All nine checks of an answer with their weights; six of them are hard."""
    k = F.col("o_orderkey")
    mods = dict(zip(GOLD, (2, 3, 5, 4, 7, 11, 13, 17, 19), strict=True))
    o = table(spark, sf_dir, "orders").select(k.alias("k"), *[((k % m) / 3.0 >= ev.PRECISION if n == "citation_precision" else k % m > 0).alias(n) for n, m in mods.items()])
    return ev.weighted_checks(o, ev.CHECKS, hard=GOLD[:6]).select("k", "score", "accepted")


@query(
    f"""WITH {BM25.format(filter="true")}, h AS (SELECT search_id, len(list_intersect({sql_tokens("query")}, {sql_tokens("title")})) AS n, len({sql_tokens("title")}) AS l FROM hits JOIN docs USING (doc_id) JOIN searches USING (search_id) WHERE matched >= min_match)
SELECT search_id, round(CAST(max(CASE WHEN l = 0 THEN 0 ELSE n + least(0.5, 0.03 * l) END) AS DOUBLE), 6) AS best_overlap, count(*) AS hits FROM h GROUP BY search_id"""
)
def scope_quality(spark, sf_dir):
    """How well the titles of a search's hits fit its question, at best."""
    s = searches(spark, sf_dir)
    d = docs(spark, sf_dir).select("doc_id", t.tokens(F.col("title")).alias("tt"))
    x = se.bm25(index(spark, sf_dir), s).select("search_id", "doc_id").join(d, "doc_id").join(se.side(s.select("search_id", t.tokens(F.col("query")).alias("qt"))), "search_id")
    return x.groupBy("search_id").agg(F.round(F.max(t.overlap_score(F.col("qt"), F.col("tt"))), 6).alias("best_overlap"), F.count(F.lit(1)).alias("hits"))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 AND p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5) ORDER BY p_partkey LIMIT 20")
def case_selection(spark, sf_dir):
    """Cases of a tier and of some categories, in the suite's order, the first twenty."""
    p = table(spark, sf_dir, "part")
    brands = [r[0] for r in p.select("p_brand").distinct().orderBy("p_brand").limit(5).collect()]
    cases = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("position"), F.col("p_brand").alias("category"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("smoke"), F.lit("full"))).otherwise(F.array(F.lit("full"))).alias("tiers"))
    return ev.select_cases(cases, tier="smoke", categories=brands, limit=20).select("id")


@query(
    f"""WITH p AS (SELECT p_partkey, {sql_tokens("p_name || ' ' || p_type")} AS a FROM part)
SELECT p_partkey, array_to_string(list_filter(a, lambda x: NOT list_contains(['yang', 'dan', 'the', 'steel', 'small'], x)), ' ') AS kept FROM p"""
)
def stopword_tokens(spark, sf_dir):
    """Tokens without stop words, which are read from a file of a word a line."""
    path = files.scratch(spark, "stopwords.txt")
    files.write_pointer(spark, path, "# words\nyang\ndan\n\nThe\nsteel\n small \n")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.tokens(F.concat_ws(" ", "p_name", "p_type"), files.read_words(spark, path)), " ").alias("kept"))


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 1.45 WHEN 1 THEN 1.15 ELSE 1.0 END AS DOUBLE) AS phrases, CAST(CASE WHEN p_partkey % 4 = 1 THEN 0.55 WHEN p_partkey % 4 = 2 THEN 0.70 ELSE 1.0 END AS DOUBLE) AS sector, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5.0 ELSE 1.0 END AS DOUBLE) AS listed,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 2.25 WHEN p_partkey % 5 = 1 THEN 0.65 ELSE 1.0 END AS DOUBLE) AS subject, CAST(CASE p_partkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 2.5 WHEN 2 THEN 5.0 ELSE 1.0 END AS DOUBLE) AS aggregate,
  CAST(CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.65 WHEN 3 THEN 1.0 ELSE 0.65 END AS DOUBLE) AS anchor, CAST(CASE WHEN p_partkey % 3 < 2 THEN 1.08 ELSE 1.0 END AS DOUBLE) AS issuer FROM part"""
)
def multipliers(spark, sf_dir):
    """The factors of a planned search's score, one case each."""
    k = F.col("p_partkey")
    two = F.array(F.lit("modal inti"), F.lit("tidak ditanya"))
    phrase = scoring.phrase_boost(F.lit("berapa modal inti bank"), pick(k, "modal inti bank umum", "lain", "lain"), pick(k, "x", "memuat modal inti", "y"), two)
    sector = scoring.sector_factor(pick(k, "bank umum", "bank umum", "bpr", "apa"), pick(k, "bank umum", "bpr syariah", "bank umum", "bpr"), ["bank umum"], ["bpr"])
    listed = scoring.list_multiplier(pick(k, "direct_enumeration:jenis", "topic:x"), F.lit(True), F.lit("ayat"))
    long = "kata " * 60
    subject = scoring.subject_multiplier(pick(k, "kewajiban pelapor", "kewajiban pelapor", "apa", "kewajiban pelaporan", "apa"), pick(k, "Pelapor wajib", long + "pelapor", "pelapor", "pelapor", "x"), ["pelapor"])
    aggregate = scoring.aggregate_multiplier(pick(k, "a dan b", "sebutkan isi", "apa saja a dan b", "isi"), F.lit(True))
    anchor = scoring.anchor_multiplier(k % 5 > 0, k % 5 > 1, F.when(k % 5 == 2, 0).when(k % 5 == 3, 1).otherwise(4))
    issuer = scoring.issuer_boost(pick(k, "BI", "OJK", "BI"), F.when(k % 3 == 1, F.array(F.lit("ojk"))).when(k % 3 == 0, F.array(F.lit("bank"))).otherwise(F.array(F.lit("ojk"))))
    return table(spark, sf_dir, "part").select("p_partkey", phrase.alias("phrases"), sector.alias("sector"), listed.alias("listed"), subject.alias("subject"), aggregate.alias("aggregate"), anchor.alias("anchor"), issuer.alias("issuer"))


@query(
    """SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 14.0 WHEN 1 THEN 10.0 WHEN 2 THEN -18.0 WHEN 3 THEN -6.0 WHEN 4 THEN 24.0 ELSE -40.0 END
  + CASE event_id % 4 WHEN 0 THEN 8.0 WHEN 1 THEN 18.0 WHEN 2 THEN 28.0 ELSE 0.0 END AS DOUBLE) AS score FROM events"""
)
def answer_bonuses(spark, sf_dir):
    """Parts of an answer's rank: what the question asks and the claim says, and the question's words in title and searches."""
    k = F.col("event_id")
    q = pick(k, "kewajiban lapor", "apa itu lapor", "isi lapor", "isi lapor", "perpanjangan lapor", "perpanjangan lapor")
    c = pick(k, "pihak wajib", "sesuatu adalah", "dimaksud dalam hal", "hal meliputi:", "memperpanjang", "lain")
    anchor = pick(k, "ketentuanxx", "lapor", "ketentuanxx lapor tambahan", "")
    terms = F.array(F.lit("ketentuanxx"), F.lit("lapor"), F.lit("tambahan"))
    none = F.array().cast("array<string>")
    score = claims.rank(q, terms, c, none, F.lit(0.0), F.lit("x"), F.lit("x"), F.lit("x"), anchor, none)
    return table(spark, sf_dir, "events").select("event_id", score.alias("score"))


@query(
    r"""SELECT p_partkey, p_brand AS phrase, CASE p_partkey % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'entity' ELSE 'alias' END AS kind, 'modal ' || p_size AS term, 'Rasio ' || p_size AS long_form, 'R' || p_size AS alias,
  CASE WHEN p_partkey % 2 = 0 THEN 'bank umum,' || lower(replace(p_brand, '#', '')) ELSE 'bank umum' END AS parts, p_partkey % 4 > 1 AS valid FROM part"""
)
def lexicon_phrases(spark, sf_dir):
    """Phrases of the lexicon from titles, headings, definitions and abbreviations."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    phrase = lx.normalize_phrase(F.concat(F.lit("1.2) POJK tentang "), "p_brand", F.lit(" (bagian satu)")))
    kind = lx.phrase_type(pick(k, "modal kerja", "bank umum modal", "KPMM-2"), ["bank"], ["modal"])
    defined = lx.defined_terms(F.concat(F.lit("1. modal "), size, F.lit(" adalah uang.")))
    pairs = lx.alias_pairs(F.concat(F.lit("Rasio "), size, F.lit(" yang selanjutnya disingkat R"), size, F.lit(" wajib")))
    parts = lx.title_phrases(F.concat(F.lit("bank umum"), F.when(k % 2 == 0, F.concat(F.lit(" tentang "), F.lower(F.regexp_replace("p_brand", "#", "")))).otherwise("")))
    valid = lx.valid_phrase(pick(k, "12/3", "a | b", "modal inti", "bank umum syariah"))
    return table(spark, sf_dir, "part").select("p_partkey", phrase.alias("phrase"), kind.alias("kind"), defined[0].alias("term"), pairs[0]["long"].alias("long_form"), pairs[0]["alias"].alias("alias"), F.array_join(parts, ",").alias("parts"), valid.alias("valid"))


@query(
    f"""WITH {UNITS}, f AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS v, issuer, title FROM units)
SELECT doc_id, pos, CASE WHEN length(v) <= 360 THEN v ELSE rtrim(CASE WHEN regexp_extract(substr(v, 1, 361), '^(.*)\\s', 1) = '' THEN substr(v, 1, 360) ELSE regexp_extract(substr(v, 1, 361), '^(.*)\\s', 1) END) || '…' END AS short,
  issuer || '|' || doc_id || '|' || CASE WHEN pos % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END AS key, CASE WHEN pos % 2 = 0 THEN 'query: ' || issuer ELSE 'query: x' END AS prefixed, regexp_matches(lower(v), '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)') AS has_the, substr(trim(regexp_replace(title || ' ' || line, '\\s+', ' ', 'g')), 1, 6000) AS embedded FROM f JOIN units USING (doc_id, pos, issuer, title)"""
)
def unit_texts(spark, sf_dir):
    """Units shortened at a space, keyed, prefixed, searched by whole words, and joined for an encoder."""
    u = units(spark, sf_dir)
    pos = F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string"))
    prefixed = t.with_prefix(F.when(F.col("pos") % 2 == 0, F.col("issuer")).otherwise("query: x"), "query: ")
    return u.select("doc_id", "pos", t.truncate_at_space(F.col("line")).alias("short"), t.composite_key(F.col("issuer"), F.col("doc_id"), pos).alias("key"), prefixed.alias("prefixed"), t.contains_term(F.col("line"), "the").alias("has_the"), t.embedding_text(F.col("title"), F.col("line")).alias("embedded"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name || ' memuat ' || CASE p_partkey % 4 WHEN 0 THEN 'KPMM' ELSE 'Kewajiban Modal' END || ' Istilah terkait: Kewajiban Modal (KPMM).'
  WHEN p_partkey % 4 = 2 THEN p_name || ' memuat Kewajiban Modal KPMM' ELSE p_name || ' memuat tidak ada' END AS text FROM part"""
)
def appended_aliases(spark, sf_dir):
    """A unit that has one form of a term that its document abbreviates gets the other one."""
    k = F.col("p_partkey")
    u = table(spark, sf_dir, "part").select("p_partkey", F.floor(k / 4).alias("doc"), F.concat("p_name", F.lit(" memuat "), pick(k, "KPMM", "Kewajiban Modal", "Kewajiban Modal KPMM", "tidak ada")).alias("text"))
    aliases = u.select("doc").distinct().select("doc", F.lit("KPMM").alias("alias"), F.lit("Kewajiban Modal").alias("long_form"))
    return un.with_aliases(u, aliases, ["doc"], ["p_partkey"], "text").select("p_partkey", "text")


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a.,b.' WHEN 1 THEN '1)' ELSE '' END AS labels, CASE p_partkey % 3 WHEN 0 THEN 'a. ' || p_brand || '; b. ' || p_type WHEN 1 THEN '1) ' || p_name END AS text FROM part"""
)
def geometry_blocks(spark, sf_dir):
    """The labels of a block's text, and the entries of its page that have them side by side."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(pick(k, "a. satu b. dua", "1) satu", "tanpa label")).alias("block"),
        F.array(F.concat(F.lit("1) "), "p_name"), F.concat(F.lit("a. "), "p_brand"), F.concat(F.lit("b. "), "p_type")).alias("entries"),
    )
    return geo.matched_blocks(p, "p_partkey", "block", "entries")


@query(
    f"""WITH i AS (SELECT item_id, item_id % 3 AS k FROM benchmark) SELECT item_id AS query_id, CASE WHEN k = 0 THEN 'partial' ELSE 'strong' END AS label, CASE WHEN k = 0 THEN 'OJK' ELSE '' END AS missing FROM i"""
)
def coverage_gate(spark, sf_dir):
    """Questions that ask two issuers: one that is not covered directly makes the answer partial."""
    i = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    sure = i.select("query_id", F.lit("strong").alias("label"), F.lit(False).alias("must_say_not_found"))
    items = i.select("query_id", F.lit("BI").alias("issuer"), F.lit(True).alias("direct"), F.lit(False).alias("adjacent")).unionByName(i.select("query_id", F.lit("OJK").alias("issuer"), (F.col("query_id") % 3 > 0).alias("direct"), F.lit(True).alias("adjacent")))
    covered = ed.issuer_coverage(items, i.select("query_id", F.explode(F.array(F.lit("BI"), F.lit("OJK"))).alias("issuer")))
    return ed.gate_by_coverage(sure, covered).select("query_id", "label", F.coalesce(F.array_join("missing_direct_issuers", ","), F.lit("")).alias("missing"))


LOST = (0, 0.23, 0.12, 0.06, 0.08, 0.07, 0.06, 0.04, 0.03, 0.03, 0.02, 0.01, 0.04, 0.08, 0.07, 0.07, 0.08, 0.05)
FAILED = (0, 3, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1)


@query(
    f"""WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 18 + 1 AS INTEGER) AS k FROM orders)
SELECT o_orderkey, round(CAST(least(1.0, 1.06 - {list(LOST)}[k]) AS DOUBLE), 3) AS score, CAST({list(FAILED)}[k] AS INTEGER) AS failures, CAST(CASE WHEN k - 1 IN (7, 14, 16) THEN 1 ELSE 0 END AS INTEGER) AS warnings, k - 1 IN (0, 7) AS accepted FROM k"""
)
def answer_quality(spark, sf_dir):
    """An answer that is right in all, and seventeen that are each wrong in one way."""
    k = F.col("o_orderkey") % 18

    def texts(*values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    finding = F.struct(F.when(k == 13, "Kewajiban meliputi:").otherwise("Pihak wajib melapor.").alias("text"), F.lit("supported").alias("status"), F.when(k == 14, texts("c1")).otherwise(texts("c1")).alias("citation_ids"))

    def citation(name):
        end = F.when(k == 15, 1).otherwise(3)
        return F.struct(F.lit(name).alias("id"), F.lit("f").alias("file_id"), F.lit("OJK").alias("issuer"), F.lit("POJK 1").alias("text"), texts("b").alias("source_block_ids"), F.lit(2).alias("page_start"), end.alias("page_end"))

    citations = F.when(k == 14, F.array(citation("c1"), citation("c1"))).when(k == 16, F.array(citation("c1"), citation("c2"))).otherwise(F.array(citation("c1")))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 11, "partial").otherwise("answerable").alias("expected"), F.when(k == 1, "not_found").when(k == 11, "partial").otherwise("answerable").alias("status"),
        F.when(k == 9, "Menimbang : bahwa wajib").when(k == 10, "Jawaban:\n- potongan wajib").otherwise("Jawaban: wajib.").alias("answer"), F.lit("Ringkasan").alias("summary"),
        F.when(k == 12, F.array_repeat(finding, 4)).otherwise(F.array(finding)).alias("findings"), citations.alias("citations"),
        F.array(F.struct(F.lit("OJK").alias("issuer"), F.when(k == 7, "secondary").otherwise("primary").alias("source_priority"))).alias("documents"), F.when(k == 17, 2).otherwise(F.size(citations)).alias("citation_count"),
        F.when(k == 2, texts("wajib", "sanksi")).otherwise(texts("wajib")).alias("required_terms"), F.when(k == 3, texts("parsial")).otherwise(texts()).alias("uncertainty_terms"), F.when(k == 4, texts("pbi")).otherwise(texts("pojk")).alias("citation_terms"),
        F.when(k == 6, texts("OJK", "BI")).otherwise(texts("OJK")).alias("required_issuers"), F.when(k == 5, 2).alias("min_citations"), F.when(k == 8, 5).alias("max_chars"),
    )
    return qu.answer_quality(o).select("o_orderkey", "score", F.size("failures").alias("failures"), F.size("warnings").alias("warnings"), "accepted")


ARTIFACTS = f"""{UNITS}, a AS (SELECT doc_id, pos, ['bab', 'table', 'pasal', 'ayat', 'huruf'][level] AS unit_type, CASE WHEN pos % 7 = 0 THEN 'promulgation' WHEN pos % 5 = 0 THEN NULL ELSE 'normative' END AS part, CASE WHEN pos % 13 = 0 THEN line || ' pada ayat' WHEN pos % 17 = 0 THEN 'Cukup jelas.' ELSE line END AS line,
  CASE WHEN pos % 19 = 0 THEN 'http://jdih.ojk.go.id/x' ELSE line END AS found, page, pos % 3 AS more, pos % 4 > 0 AS has_path, CASE doc_id % 4 WHEN 0 THEN 'PBI' WHEN 1 THEN 'POJK' ELSE 'SK' END AS kind, issuer, pos % 3 > 0 AS admitted, pos % 11 > 0 AS has_node, NOT contains(line, '|') AS readable, doc_id % 6 > 0 AS is_primary FROM units),
b AS (SELECT *, false AS of_corpus, true AS judged FROM a WHERE pos % 2 = 1), c AS (SELECT * REPLACE (true AS admitted), true AS of_corpus, pos % 2 = 0 AS judged FROM a WHERE pos % 3 > 0), e AS (SELECT * FROM b UNION ALL SELECT * FROM c),
v AS (SELECT doc_id, pos, unnest(list_filter([CASE WHEN NOT has_node OR line = '' OR found = '' OR part IS NULL THEN 'missing_legal_unit_provenance' END,
  CASE WHEN judged AND admitted AND unit_type IN ('pasal', 'ayat', 'huruf') AND regexp_matches(line, '(?i)\\b((pada|dalam|di)\\s+)?(ayat|pasal|huruf)\\s*$') THEN 'dangling_legal_reference' END,
  CASE WHEN judged AND admitted AND unit_type = 'pasal' AND coalesce(part, 'normative') = 'normative' AND (more >= 2 AND length(line) > 1500 OR length(line) > 3000) THEN 'oversized_normative_pasal' END,
  CASE WHEN judged AND (regexp_matches(line, 'jdih\\.ojk\\.go\\.id') OR regexp_matches(found, 'jdih\\.ojk\\.go\\.id')) THEN 'url_contamination' END, CASE WHEN judged AND admitted AND NOT has_path THEN 'empty_legal_path' END,
  CASE WHEN judged AND (kind = 'PBI' AND issuer <> 'BI' OR kind = 'POJK' AND issuer <> 'OJK') THEN 'issuer_instrument_mismatch' END, CASE WHEN of_corpus AND NOT is_primary THEN 'suppressed_duplicate_leakage' END,
  CASE WHEN judged AND admitted AND unit_type = 'table' AND NOT readable THEN 'unreadable_table_citation_admission' END,
  CASE WHEN judged AND admitted AND (part = 'promulgation' OR coalesce(part, 'normative') = 'normative' AND line = 'Cukup jelas.') THEN 'document_part_contamination' END], lambda x: x IS NOT NULL)) AS rule FROM e)"""


@query(f"WITH {ARTIFACTS} SELECT rule, count(*) AS violations FROM v GROUP BY rule")
def artifact_audit(spark, sf_dir):
    """All nine rules over the units and the corpus made of them; a unit that is in both is judged once for what it is."""
    u, p = units(spark, sf_dir), F.col("pos")
    line = F.when(p % 13 == 0, F.concat("line", F.lit(" pada ayat"))).when(p % 17 == 0, "Cukup jelas.").otherwise(F.col("line"))
    some = F.array(F.lit("x"))
    a = u.select(
        "doc_id", "pos", F.array(*map(F.lit, ("bab", "table", "pasal", "ayat", "huruf")))[F.col("level") - 1].alias("unit_type"), F.when(p % 7 == 0, "promulgation").when(p % 5 == 0, None).otherwise("normative").alias("document_part"), line.alias("display_text"),
        F.when(p % 19 == 0, "http://jdih.ojk.go.id/x").otherwise(F.col("line")).alias("retrieval_text"), F.col("page").alias("page_start"), (F.col("page") + p % 3).alias("page_end"), F.when(p % 4 > 0, some).alias("legal_path"), pick(F.col("doc_id"), "PBI", "POJK", "SK", "SK").alias("regulation_type"),
        "issuer", F.when(p % 3 > 0, "atomic_leaf").otherwise("quarantined").alias("admission"), F.when(p % 11 > 0, "n").alias("node_id"), F.lit("u").alias("legal_unit"), some.alias("source_block_ids"), some.alias("anchors"), some.alias("source_spans"),
        (~F.contains("line", F.lit("|"))).alias("readable"), (F.col("doc_id") % 6 > 0).alias("searchable_primary"),
    )
    return qu.audit_units(a.where("pos % 2 = 1"), a.where("pos % 3 > 0").drop("admission"), ("doc_id", "pos")).select("rule", "violations")
