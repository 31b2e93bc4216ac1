"""Plans of questions and their execution."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import index as ix
from ..plans import execute as ex
from ..plans import planner as pl
from ..sources import files
from .answers import LEXICON
from .base import BM25, SEARCHES, index, pick, query, sql_tokens, table

QUESTION = f"""q AS (SELECT item_id AS query_id, array_to_string({sql_tokens("text")}, ' ') || CASE item_id % 4 WHEN 0 THEN ' wajib?' WHEN 1 THEN ' sanksi?' WHEN 2 THEN ' ojk wajib?' ELSE ' bank indonesia wajib?' END AS raw_query FROM benchmark),
w AS (SELECT *, {sql_tokens("raw_query")} AS ws, regexp_matches(lower(raw_query), '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)') AS e, contains(lower(raw_query), 'license') OR regexp_matches(lower(raw_query), '(^|[^\\p{{L}}\\p{{N}}_])ou([^\\p{{L}}\\p{{N}}_]|$)') AS tp,
  contains(lower(raw_query), 'wajib') AS ob, contains(lower(raw_query), 'sanksi') AS sa, contains(lower(raw_query), 'bank indonesia') AS xb, contains(lower(raw_query), 'bank') AS xk,
  regexp_matches(lower(raw_query), '(^|[^\\p{{L}}\\p{{N}}_])ojk([^\\p{{L}}\\p{{N}}_]|$)') AS xo, regexp_matches(lower(raw_query), '(^|[^\\p{{L}}\\p{{N}}_])bi([^\\p{{L}}\\p{{N}}_]|$)') AS wb FROM q),
f AS (SELECT *, list_filter([CASE WHEN xo THEN 'OJK' END, CASE WHEN xb THEN 'BI' END], lambda x: x IS NOT NULL) AS ex FROM w),
g AS (SELECT *, list_filter([CASE WHEN tp THEN 'BI' END, CASE WHEN xo THEN 'OJK' END, CASE WHEN wb AND NOT tp THEN 'BI' END], lambda x: x IS NOT NULL) AS inferred FROM f),
p AS (SELECT *, CASE WHEN len(ex) > 0 THEN ex WHEN len(inferred) > 0 THEN inferred WHEN xk THEN ['OJK'] ELSE [CAST(NULL AS VARCHAR)] END AS issuers FROM g)"""


PLANNED = f"""{QUESTION}, sx AS (
  SELECT query_id, 0 AS a, 0 AS b, raw_query AS query, CASE WHEN len(ex) = 1 THEN ex[1] WHEN len(list_filter(issuers, lambda x: x IS NOT NULL)) > 1 THEN NULL ELSE issuers[1] END AS issuer, NULL AS role, 'raw_user_query' AS reason FROM p
  UNION ALL SELECT query_id, 1, n * 10 + j, x, i, 'primary_regulation', 'topic:copies' FROM (
    SELECT query_id, unnest(CASE WHEN len(ex) > 0 THEN ex ELSE ['BI'] END) AS i, unnest(range(len(CASE WHEN len(ex) > 0 THEN ex ELSE ['BI'] END))) AS j, ws FROM p WHERE tp) y,
    LATERAL (SELECT unnest(CASE WHEN len(list_intersect(ws, ['ouwhea', 'the', 'of', 'rend'])) > len(list_intersect(ws, ['released', 'under', 'the', 'license'])) THEN ['ouwhea the of rend', 'released under the license'] ELSE ['released under the license', 'ouwhea the of rend'] END) AS x, unnest([0, 1]) AS n)
  UNION ALL SELECT query_id, 2, j, 'the reading of the', i, 'primary_regulation', 'entity:reader' FROM (SELECT query_id, unnest(issuers) AS i, unnest(range(len(issuers))) AS j FROM p WHERE e)
  UNION ALL SELECT query_id, 3, unnest([0, 1, 2]), unnest(['sanksi administratif', 'pelanggaran ketentuan', 'denda teguran pencabutan izin']), issuers[1], 'primary_regulation', 'intent:sanctions' FROM p WHERE sa),
planned AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY a, b) - 1 AS INTEGER) AS search_rank, query, issuer, role, reason FROM sx)"""


def _asked(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat(F.array_join(t.tokens(F.col("text")), " "), pick(i, " wajib?", " sanksi?", " ojk wajib?", " bank indonesia wajib?")).alias("raw_query"))


@query(
    f"""WITH {QUESTION} SELECT query_id, array_to_string(CASE WHEN ob AND sa THEN ['obligations', 'sanctions'] WHEN ob THEN ['obligations'] WHEN sa THEN ['sanctions'] ELSE ['find_regulations'] END, ',') AS intents,
  array_to_string(list_transform(issuers, lambda x: coalesce(x, '-')), ',') AS issuers, CASE WHEN e THEN 'reader' ELSE '' END AS entities, CASE WHEN tp THEN 'copies' ELSE '' END AS topics, NOT tp AS titles_may_limit,
  len(list_filter(issuers, lambda x: x IS NOT NULL)) > 1 AND NOT ob AND NOT sa AS compares_issuers FROM p"""
)
def plan_facts(spark, sf_dir):
    """What the planner, its lexicon read from a file, reads from a question: intents, issuers, entities, topics; whether titles
    may limit it, whether it compares issuers."""
    path = files.scratch(spark, "lexicon.json")
    files.write_pointer(spark, path, json.dumps(LEXICON))
    return pl.facts(_asked(spark, sf_dir), files.read_lexicon(spark, path))


@query(
    f"WITH {PLANNED} SELECT query_id, search_rank, query, issuer, role, true AS include_secondary, reason FROM planned"
)
def query_plan(spark, sf_dir):
    """The searches of a question for every test item: itself, its topics' and entities' expansions, its intent's."""
    return pl.plan_questions(_asked(spark, sf_dir), LEXICON, 12)


@query(
    f"""WITH {QUESTION}, h AS (SELECT *, regexp_matches(lower(raw_query), '(^|[^\\p{{L}}\\p{{N}}_])ou([^\\p{{L}}\\p{{N}}_]|$)') AS ou FROM p)
SELECT query_id, array_to_string(list_concat(list_concat(ws, CASE WHEN e THEN ['the', 'reading', 'of', 'the'] ELSE [] END), CASE WHEN ou THEN ['released', 'under', 'the', 'license', 'ouwhea', 'the', 'of', 'rend'] ELSE [] END), ' ') AS terms FROM h"""
)
def expanded_terms(spark, sf_dir):
    """A question's tokens and those of the entries that a short word of it names."""
    return pl.expanded(_asked(spark, sf_dir), LEXICON)


SCOPED = "(s.issuer IS NULL OR s.issuer = d.issuer) AND (s.role IS NULL OR s.role = d.role)"
FOUND = BM25.format(filter=SCOPED).replace(SEARCHES, PLANNED + ", searches AS (SELECT query_id * 1000 + search_rank AS search_id, planned.*, raw_query FROM planned JOIN q USING (query_id))")


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) + least(0.5, 0.03 * len({b})) END"


@query(
    f"""WITH {FOUND}, h AS (SELECT search_id, doc_id, row_number() OVER (PARTITION BY search_id ORDER BY round(bm25, 6) DESC, doc_id) - 1 AS rk FROM hits WHERE matched >= min_match),
x AS (SELECT s.query_id, s.search_rank, s.reason, h.doc_id, rk, d.title, d.text, d.issuer, d.role, {sql_tokens("d.title")} AS tt, {sql_tokens("s.raw_query")} AS rt, {sql_tokens("s.query")} AS st FROM h JOIN searches s USING (search_id) JOIN docs d ON d.doc_id = h.doc_id WHERE rk < 48),
y AS (SELECT query_id, doc_id, title, substr(text, 1, 120) AS head, issuer, reason, round(100.0 / (rk + 5) * CASE WHEN reason LIKE 'topic%' THEN 1.25 WHEN reason LIKE 'intent%' THEN 1.08 WHEN reason LIKE 'entity%' THEN 1.03 ELSE 0.9 END / (1 + 0.1 * search_rank)
  * (1 + least(0.6, ({_overlap("rt", "tt")}) * 0.10 + ({_overlap("st", "tt")}) * 0.04)) * CASE role WHEN 'primary_regulation' THEN 1.6 WHEN 'attachment' THEN 1.05 WHEN 'operational_requirement' THEN 0.72 WHEN 'secondary_faq' THEN 0.58 ELSE 0.5 END, 6) AS score FROM x),
o AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, reason) = 1),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, title, head ORDER BY score DESC, doc_id) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, issuer ORDER BY score DESC, doc_id) > 6 AS late FROM u),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, doc_id) <= 12)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS place, doc_id, score, reason FROM b"""
)
def execute_plans(spark, sf_dir):
    """All searches of all questions' plans, as one set of joins."""
    q = _asked(spark, sf_dir)
    none = F.lit(None).cast("string")
    base = index(spark, sf_dir)
    d = base.docs.withColumns({"file_id": F.col("doc_id"), "number": F.col("source"), "pasal": none, "ayat": none, "huruf": none})
    out = ex.execute(ix.Index(d, base.postings, base.terms, base.stats), pl.plan_questions(q, LEXICON, 12), q)
    return out.withColumn("score", F.round("score", 6))
