"""Index and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as t
from ..operators import blockmax as bx
from ..operators import index as ix
from ..operators import positions as ps
from ..operators import search as se
from ..operators import vector_index as vi
from ..sources.files import scratch
from .base import BM25, DOCS, INDEX, SEARCHES, UNITS, docs, index, packed, query, searches, sql_tokens, table, units


def _index(spark, sf_dir):
    return index(spark, sf_dir)


@query(f"WITH {INDEX} SELECT tok.doc_id, CAST(len(ts) AS INTEGER) AS n_tokens, CAST(len(list_distinct(ts)) AS INTEGER) AS n_distinct, coalesce(ts[1], '') AS first_token FROM tok")
def tokenize_stats(spark, sf_dir):
    ts = t.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(ts).alias("n_tokens"), F.size(t.unique(ts)).alias("n_distinct"), F.coalesce(F.get(ts, F.lit(0)), F.lit("")).alias("first_token"))


@query(f"WITH {INDEX} SELECT term, doc_id, tf FROM postings")
def postings_build(spark, sf_dir):
    return ix.build(docs(spark, sf_dir)).postings


@query(f"WITH {INDEX} SELECT term, df FROM terms")
def term_df(spark, sf_dir):
    return _index(spark, sf_dir).terms


@query(f"WITH {INDEX} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats")
def doc_length_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(
    f"WITH {BM25.format(filter='true')}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(bm25, 6) DESC, doc_id) AS rk FROM hits) "
    "SELECT search_id, doc_id, round(bm25, 6) AS bm25, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 50"
)
def bm25_topk(spark, sf_dir):
    """The best of all documents that have any term of a search."""
    out = se.bm25(_index(spark, sf_dir), searches(spark, sf_dir), min_match=False, limit=50, most=None)
    return out.select("search_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


PRUNED = (
    f"WITH {BM25.format(filter='true')}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(bm25, 6) DESC, doc_id) AS rk FROM hits WHERE matched >= {{least}}) "
    "SELECT search_id, doc_id, round(bm25, 6) AS bm25, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= {most}"
)


@query(PRUNED.format(least=1, most=50))
def bm25_block_max(spark, sf_dir):
    """The best of the documents that have one of a search's rarest terms, from packed blocks, of which those are skipped that
    can't reach the fiftieth place."""
    out = bx.pruned_top(packed(spark, sf_dir), _index(spark, sf_dir), searches(spark, sf_dir), 50, min_match=False)
    return out.select("search_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(PRUNED.format(least="min_match", most=10))
def bm25_block_max_min_match(spark, sf_dir):
    out = bx.pruned_top(packed(spark, sf_dir), _index(spark, sf_dir), searches(spark, sf_dir), 10)
    return out.select("search_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {BM25.format(filter='true')} SELECT search_id, doc_id, matched, round(bm25, 6) AS bm25 FROM hits WHERE matched >= min_match")
def bm25_candidates_min_match(spark, sf_dir):
    return se.bm25(_index(spark, sf_dir), searches(spark, sf_dir)).select("search_id", "doc_id", "matched", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {BM25.format(filter='s.issuer IS NULL OR s.issuer = d.issuer')} SELECT search_id, doc_id, round(bm25, 6) AS bm25 FROM hits WHERE matched >= min_match")
def bm25_filtered_scope(spark, sf_dir):
    return se.bm25(_index(spark, sf_dir), searches(spark, sf_dir), filters=("issuer",)).select("search_id", "doc_id", F.round("bm25", 6).alias("bm25"))


SCOPE = "NOT (search_id % 2 = 0 AND d.lang <> 'en')"


@query(
    f"WITH {BM25.format(filter=SCOPE)} SELECT search_id, doc_id, round(bm25, 6) AS bm25 FROM hits WHERE matched >= min_match",
)
def bm25_scope_table(spark, sf_dir):
    """A scope of files for every other search; the others look everywhere."""
    every = searches(spark, sf_dir)
    scope = every.where("search_id % 2 = 0").select("search_id", F.lit("en").alias("lang"))
    return se.bm25(_index(spark, sf_dir), every, scope=scope, scope_key="lang").select("search_id", "doc_id", F.round("bm25", 6).alias("bm25"))


FIELDS = (
    f"{DOCS}, tok AS (SELECT doc_id, list_concat(list_concat(list_concat({sql_tokens('title')}, {sql_tokens('title')}), {sql_tokens('title')}), {sql_tokens('text')}) AS ts FROM docs)"
)


@query(f"WITH {FIELDS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY term, doc_id")
def bm25_field_weighted(spark, sf_dir):
    return ix.build(docs(spark, sf_dir), weights={"title": 3, "text": 1}).postings


@query(
    f"""WITH {BM25.format(filter="true")}, q AS (SELECT search_id, lower(query) AS query, {sql_tokens("query")} AS ts FROM searches),
x AS (SELECT h.search_id, h.doc_id, bm25, q.query, q.ts, list_filter(q.ts, lambda u: length(u) >= 3) AS longer, lower(title) || ' ' || lower(text) || ' ' || lower(source) AS hay, {sql_tokens("title")} AS tt, role
  FROM hits h JOIN q USING (search_id) JOIN docs USING (doc_id) WHERE matched >= min_match)
SELECT search_id, doc_id, round(bm25
  * CASE WHEN contains(hay, query) THEN 1.35 WHEN len(longer) <= 6 AND len(list_filter(longer, lambda u: NOT contains(hay, u))) = 0 THEN 1.15 ELSE 1.0 END
  * (1 + least(0.5, 0.08 * len(list_intersect(ts, tt))))
  * CASE role WHEN 'primary_regulation' THEN 1.45 WHEN 'attachment' THEN 1.2 WHEN 'operational_requirement' THEN 1.1 WHEN 'secondary_faq' THEN 0.75 ELSE 0.65 END, 5) AS score FROM x"""
)
def lexical_boosts(spark, sf_dir):
    d, s = docs(spark, sf_dir).withColumn("number", F.col("source")), searches(spark, sf_dir)
    return se.boosted(se.bm25(_index(spark, sf_dir), s), d, s).select("search_id", "doc_id", F.round("score", 5).alias("score"))


TITLE = f"""q AS (SELECT search_id, query, {sql_tokens("query")} AS qt FROM (SELECT item_id AS search_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS query FROM benchmark)),
ti AS (SELECT doc_id, title, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS tn FROM docs),
tt AS (SELECT doc_id, title, tn, {sql_tokens("tn")} AS tt FROM ti),
q2 AS (SELECT *, list_distinct(qt) AS qd, list_transform(range(1, len(qt) - 2), lambda i: array_to_string(qt[i : i + 3], ' ')) AS q4, list_transform(range(1, len(qt) - 1), lambda i: array_to_string(qt[i : i + 2], ' ')) AS q3 FROM q),
t2 AS (SELECT *, list_distinct(tt) AS td, list_transform(range(1, len(tt) - 2), lambda i: array_to_string(tt[i : i + 3], ' ')) AS t4, list_transform(range(1, len(tt) - 1), lambda i: array_to_string(tt[i : i + 2], ' ')) AS t3 FROM tt),
p AS (SELECT *, len(list_intersect(qd, td)) AS sh, len(qd) AS nq, len(td) AS nt FROM q2 JOIN t2 ON list_has_any(qt, tt)),
rn AS (SELECT *, list_has_any(q4, t4) AS r4, list_has_any(q3, t3) AS r3 FROM p),
sc AS (SELECT search_id, doc_id, title, (sh / nq * 60.0 + sh / nt * 35.0 + sh * 4.0
  + CASE WHEN query = tn THEN 80.0 WHEN contains(tn, query) OR contains(query, tn) THEN 45.0 WHEN sh = nq THEN 35.0 ELSE 0 END
  + CASE WHEN contains(array_to_string(tt, ' '), array_to_string(qt, ' ')) THEN 35.0 ELSE 0 END + CASE WHEN r4 THEN 48.0 WHEN r3 THEN 36.0 ELSE 0 END)
  * CASE WHEN nt <= 2 AND nq >= 4 AND sh / nq < 0.75 THEN 0.55 ELSE 1 END AS score FROM rn)"""


def _title_searches(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.col("text").alias("query"))


@query(f"WITH {DOCS}, {TITLE} SELECT search_id, doc_id, title, round(score, 6) AS title_score FROM sc WHERE score >= 65")
def title_search(spark, sf_dir):
    out = se.title_search(docs(spark, sf_dir).select("doc_id", "title"), _title_searches(spark, sf_dir))
    return out.select("search_id", "doc_id", "title", F.round("title_score", 6).alias("title_score"))


@query(f"WITH {DOCS}, {TITLE}, m AS (SELECT search_id, max(score) AS best FROM sc WHERE score >= 65 GROUP BY search_id) SELECT search_id, doc_id, round(score, 6) AS title_score FROM sc JOIN m USING (search_id) WHERE score >= 65 AND score >= 0.75 * best")
def relative_score_cut(spark, sf_dir):
    found = se.title_search(docs(spark, sf_dir).select("doc_id", "title"), _title_searches(spark, sf_dir))
    return se.near_best(found, "title_score").select("search_id", "doc_id", F.round("title_score", 6).alias("title_score"))


PAIRS = f"""a AS (SELECT item_id, {sql_tokens("coalesce(text, '')")} AS ta FROM benchmark), b AS (SELECT doc_id, {sql_tokens("title")} AS tb FROM docs),
j AS (SELECT item_id, doc_id, len(list_intersect(ta, tb)) / greatest(1, len(list_distinct(list_concat(ta, tb)))) AS j FROM a JOIN b ON list_has_any(ta, tb))"""


@query(f"WITH {DOCS}, {PAIRS} SELECT item_id, doc_id, round(j, 6) AS jaccard FROM j WHERE j >= 0.2")
def jaccard_siblings(spark, sf_dir):
    """Test items and titles of documents that share a fifth of their words or more; pairs meet by a shared word."""
    a = _title_searches(spark, sf_dir).select(F.col("search_id").alias("item_id"), t.tokens(F.col("query")).alias("ta"))
    b = docs(spark, sf_dir).select("doc_id", t.tokens(F.col("title")).alias("tb"))
    words = a.select("item_id", F.size(F.array_distinct("ta")).alias("na"), F.explode(F.array_distinct("ta")).alias("k"))
    met = b.select("doc_id", F.size(F.array_distinct("tb")).alias("nb"), F.explode(F.array_distinct("tb")).alias("k")).join(se.side(words), "k")
    both = met.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.withColumn("j", t.jaccard_of_sizes(F.col("n"), F.col("na"), F.col("nb"))).where("j >= 0.2").select("item_id", "doc_id", F.round("j", 6).alias("jaccard"))


@query(
    f"""WITH w AS (SELECT p_partkey, {sql_tokens("p_name || ' ' || p_type || ' ' || p_name")} AS a, {sql_tokens("p_type || ' ' || p_name || ' ' || p_brand")} AS b FROM part),
g AS (SELECT p_partkey, n, b, unnest(range(1, len(a) - n + 2)) AS i, a FROM w, (SELECT unnest(range(1, 7)) AS n) WHERE len(a) >= n)
SELECT p_partkey, CAST(max(CASE WHEN contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a[i : i + n - 1], ' ') || ' ') THEN n ELSE 0 END) AS INTEGER) AS run FROM g GROUP BY p_partkey"""
)
def shared_run(spark, sf_dir):
    """Longest token sequence that two orders of a part's words share."""
    a, b = t.tokens(F.concat_ws(" ", "p_name", "p_type", "p_name")), t.tokens(F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", t.longest_run(a, b).alias("run"))


@query(f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN level = 5 THEN 0 ELSE 1 END, page, length(line), pos) AS rk FROM units) SELECT doc_id, pos, line FROM r WHERE rk = 1")
def document_representative(spark, sf_dir):
    u = units(spark, sf_dir).select("doc_id", "pos", "line", "page", F.when(F.col("level") == 5, "enumeration_aggregate").alias("admission"))
    rank = ix.representative_rank(F.col("admission"), F.lit(None).cast("string"), F.col("page"), F.lit(None).cast("string"), F.col("line"))
    return ix.representatives(u, ["doc_id"], rank, "pos").select("doc_id", "pos", "line")


DEDUPE = f"WITH {BM25.format(filter='true')}, h AS (SELECT search_id, h.doc_id, round(bm25, 6) AS bm25, title, issuer, row_number() OVER (PARTITION BY search_id, title, substr(text, 1, 120) ORDER BY round(bm25, 6) DESC, h.doc_id) AS n FROM hits h JOIN docs USING (doc_id) WHERE matched >= min_match)"


def _deduped(spark, sf_dir):
    d = docs(spark, sf_dir)
    hits = se.bm25(_index(spark, sf_dir), searches(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6)).join(d.select("doc_id", "title", "issuer", F.substring("text", 1, 120).alias("head")), "doc_id")
    return se.dedupe_ranked(hits, [F.col("title"), F.col("head")], [F.desc("bm25"), F.col("doc_id")])


@query(DEDUPE + " SELECT search_id, doc_id, bm25 FROM h WHERE n = 1")
def dedupe_ranked(spark, sf_dir):
    return _deduped(spark, sf_dir).select("search_id", "doc_id", "bm25")


@query(
    DEDUPE
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY search_id, issuer ORDER BY bm25 DESC, doc_id) > 4 AS late FROM h WHERE n = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY late, bm25 DESC, doc_id) AS place FROM g) SELECT search_id, doc_id, issuer, bm25 FROM p WHERE place <= 8"""
)
def issuer_quota_topk(spark, sf_dir):
    return se.quota_top(_deduped(spark, sf_dir), "issuer", 8, [F.desc("bm25"), F.col("doc_id")]).select("search_id", "doc_id", "issuer", "bm25")


VECTORS = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT vec_id, label, query_id, list_sum(list_transform(list_zip(embedding, qv), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings, q {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, label, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10"""


def _vectors(spark, sf_dir, where="true"):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return se.vector_top(e.where(where), q, 10).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("WITH " + VECTORS.format(where=""))
def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir)


@query()
def vector_index_topk(spark, sf_dir):
    """The ten best vectors of each question by codes and exact re-ranking of a tenth of the rows or fewer, with how many of
    the exact ten the question's rows have. Approximate, so without SQL: the test holds it against all products."""
    e = table(spark, sf_dir, "embeddings")
    dimension = e.select(F.max(F.size("embedding"))).first()[0]
    book = vi.fit(e, dimension)
    codes = vi.write_codes(vi.build(e, book), scratch(spark, "codes"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vi.search_blocks(scratch(spark, "found"), codes, e, book, q, 10, rerank=min(500, max(10, codes.count() // 10)))
    exact = vi.recall(found, se.vector_top(e, q, 10).select("query_id", "vec_id"))
    return found.join(exact, "query_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank", "n_exact", "n_found")


@query("WITH " + VECTORS.format(where="WHERE label IN (1, 3)"))
def vector_topk_filtered(spark, sf_dir):
    return _vectors(spark, sf_dir, "label IN (1, 3)")


@query(
    f"""WITH {BM25.format(filter="true")}, x AS (SELECT h.search_id, h.doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f, {sql_tokens("query")} AS ts FROM hits h JOIN searches USING (search_id) JOIN docs USING (doc_id) WHERE matched >= min_match),
y AS (SELECT *, greatest(0, coalesce(list_min(list_filter(list_transform(ts, lambda u: instr(lower(f), u) - 1), lambda p: p >= 0)), 120) - 120) AS a FROM x)
SELECT search_id, doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substr(f, CAST(a AS BIGINT) + 1, 420) || CASE WHEN a + 420 < length(f) THEN '...' ELSE '' END AS snippet FROM y"""
)
def snippets(spark, sf_dir):
    """A snippet of every hit of every search."""
    s = searches(spark, sf_dir)
    hits = se.bm25(_index(spark, sf_dir), s).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return hits.join(se.side(s.select("search_id", t.tokens(F.col("query")).alias("ts"))), "search_id").select("search_id", "doc_id", t.snippet(F.col("text"), F.col("ts")).alias("snippet"))


@query(f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS n FROM units WHERE doc_id % 50 = 0) SELECT doc_id, pos, line, page FROM r WHERE n = 1")
def doc_lookup(spark, sf_dir):
    """The first unit of each document that is asked for: those whose ids are divisible by 50."""
    wanted = docs(spark, sf_dir).where("doc_id % 50 = 0").select("doc_id")
    return ix.lookup(units(spark, sf_dir).select("doc_id", "pos", "line", "page"), wanted, "doc_id", ["page", "pos"]).select("doc_id", "pos", "line", "page")


@query(f"WITH {INDEX} SELECT term, df, n_docs, round(avg_len, 6) AS avg_len FROM terms, stats")
def incremental_index(spark, sf_dir):
    """Two halves indexed one after the other give the index of all."""
    d = docs(spark, sf_dir)
    both = ix.append(ix.build(d.where("doc_id % 2 = 0")), ix.build(d.where("doc_id % 2 = 1")))
    return both.terms.crossJoin(F.broadcast(both.stats)).select("term", "df", F.col("n_docs").cast("long").alias("n_docs"), F.round("avg_len", 6).alias("avg_len"))


@query(
    f"""WITH {BM25.format(filter="true")}, h AS (SELECT search_id, doc_id, row_number() OVER (PARTITION BY search_id ORDER BY round(bm25, 6) DESC, doc_id) - 1 AS rk FROM hits WHERE matched >= min_match),
o AS (SELECT search_id, h.doc_id, rk, role, len(list_intersect({sql_tokens("query")}, {sql_tokens("title")})) AS ov FROM h JOIN docs USING (doc_id) JOIN searches USING (search_id) WHERE rk < 16)
SELECT search_id, doc_id, round(100.0 / (rk + 5) * CASE search_id % 2 WHEN 0 THEN 1.25 ELSE 1.8 END / (1 + 0.1 * (search_id % 4)) * (1 + least(0.6, ov * 0.1))
  * CASE role WHEN 'primary_regulation' THEN 1.6 WHEN 'attachment' THEN 1.05 WHEN 'operational_requirement' THEN 0.72 WHEN 'secondary_faq' THEN 0.58 ELSE 0.5 END, 6) AS score FROM o"""
)
def planned_score_batch(spark, sf_dir):
    """All searches of all plans at once: place in its search, reason, order in the plan, overlap, role."""
    d, s = docs(spark, sf_dir), searches(spark, sf_dir)
    found = se.bm25(_index(spark, sf_dir), s, limit=16).join(d.select("doc_id", "title", "role"), "doc_id").join(se.side(s), "search_id")
    overlap = F.size(F.array_intersect(t.tokens(F.col("query")), t.tokens(F.col("title"))))
    reason = F.when(F.col("search_id") % 2 == 0, "topic:x").otherwise("predicate:y")
    score = scoring.rank_score(F.col("rank") - 1) * scoring.reason_boost(reason) * scoring.order_decay(F.col("search_id") % 4) * scoring.overlap_boost(overlap, F.lit(0)) * scoring.lookup(F.col("role"), scoring.PLAN_ROLE)
    return found.select("search_id", "doc_id", F.round(score, 6).alias("score"))


@query(
    f"""WITH {UNITS}, s AS (SELECT doc_id, pos, page, level, row_number() OVER (ORDER BY length(line) DESC, doc_id, pos) AS rk FROM units), seeds AS (SELECT * FROM s WHERE rk <= 12),
par AS (SELECT doc_id, page, min(rk) AS rk FROM seeds GROUP BY doc_id, page)
SELECT u.doc_id, u.page, u.pos, CAST(par.rk AS INTEGER) AS seed FROM par JOIN units u USING (doc_id, page)"""
)
def sibling_enrichment(spark, sf_dir):
    """The units of the parents (here: pages) of the twelve best seeds, each parent once."""
    u = units(spark, sf_dir)
    best = u.orderBy(F.length("line").desc(), "doc_id", "pos").limit(12)  # twelve rows from here on
    seeds = best.withColumn("rk", F.row_number().over(Window.orderBy(F.length("line").desc(), "doc_id", "pos")))
    parents = seeds.groupBy("doc_id", "page").agg(F.min("rk").alias("seed"))
    return u.join(F.broadcast(parents), ["doc_id", "page"]).select("doc_id", "page", "pos", "seed")


#: Every run of three tokens of the test items, numbered in order of the run.
PHRASES = (
    "ph AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS phrase_id FROM (SELECT DISTINCT unnest(list_transform(range(1, len(ts) - 1), lambda i: array_to_string(ts[i : i + 2], ' '))) AS phrase FROM (SELECT "
    + sql_tokens("text")
    + " AS ts FROM benchmark)))"
)
TRIPLES = "SELECT doc_id, unnest(list_transform(range(1, len(ts) - 1), lambda i: array_to_string(ts[i : i + 2], ' '))) AS phrase, unnest(range(0, len(ts) - 2)) AS place FROM (SELECT doc_id, {0} AS ts FROM docs)"


def _phrases(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(t.tokens(F.col("text")).alias("ts")).where(F.size("ts") >= 3)
    threes = items.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ts") - 2), lambda i: F.array_join(F.slice("ts", i, 3), " "))).alias("phrase")).distinct()
    return threes.select("phrase", F.xxhash64("phrase").alias("phrase_id"))


@query(
    f"WITH {DOCS}, {PHRASES}, tr AS ({TRIPLES.format(sql_tokens('text'))}) SELECT phrase, doc_id, array_to_string(list(place ORDER BY place), ',') AS starts FROM ph JOIN tr USING (phrase) GROUP BY phrase, doc_id"
)
def phrase_positions(spark, sf_dir):
    """Where each run of three tokens of a test item stands in the documents, from positions alone."""
    phrases = _phrases(spark, sf_dir)
    found = ps.find(ps.build(docs(spark, sf_dir)), phrases)
    return found.join(phrases, "phrase_id").select("phrase", "doc_id", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(
    f"WITH {DOCS}, {PHRASES}, a AS (SELECT DISTINCT phrase, doc_id FROM ({TRIPLES.format(sql_tokens('title'))})), b AS (SELECT DISTINCT phrase, doc_id FROM ({TRIPLES.format(sql_tokens('text'))})) "
    "SELECT phrase, doc_id, CASE WHEN a.doc_id IS NULL THEN 1.15 ELSE 1.45 END::DOUBLE AS boost FROM b LEFT JOIN a USING (phrase, doc_id) JOIN ph USING (phrase)"
)
def phrase_boosts(spark, sf_dir):
    """The boost of each such run where a document has it, in its title or else in its text."""
    d, phrases = docs(spark, sf_dir), _phrases(spark, sf_dir)
    out = ps.phrase_boosts(ps.build(d, text="title"), ps.build(d), phrases)
    return out.join(phrases, "phrase_id").select("phrase", "doc_id", "boost")
