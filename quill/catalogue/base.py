"""Registry, and the engine's tables as projections of the test tables, in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-zA-Z0-9]+(?:/[a-zA-Z0-9.]+)*'), lambda t: length(t) > 1)"


def pick(number: Column, *values: str | None) -> Column:
    """The value at the number modulo how many there are."""
    return F.array(*[F.lit(v).cast("string") for v in values])[(number % len(values)).cast("int")]


#: Roles of files by document number.
ROLES = ("primary_regulation", "attachment", "operational_requirement", "secondary_faq", "secondary_summary")

DOCS = """docs AS (
  SELECT doc_id, text, lang, source, string_split(text, chr(10))[1] AS title,
    CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'BI' ELSE 'OJK' END AS issuer,
    ['primary_regulation', 'attachment', 'operational_requirement', 'secondary_faq', 'secondary_summary'][CAST(doc_id % 5 AS INTEGER) + 1] AS role
  FROM (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (a null one is empty), lang, source, title (first line), issuer, role."""
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", "text", "lang", "source", F.split("text", "\n")[0].alias("title"),
        F.when(F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0, "BI").otherwise("OJK").alias("issuer"),
        F.array(*map(F.lit, ROLES))[(F.col("doc_id") % 5).cast("int")].alias("role"),
    )


_INDEXES = {}


def index(spark: SparkSession, sf_dir: str):
    """The index of the documents' texts: built and written once a session, and read from its files by every search."""
    from ..operators.index import build, read, write
    from ..sources.files import scratch

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        path = scratch(spark, "index")
        write(build(docs(spark, sf_dir)), path)
        _INDEXES[key] = read(spark, path)
    return _INDEXES[key]


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's postings in blocks, packed and written once a session."""
    from ..operators.blockmax import pack
    from ..sources.files import scratch

    key = spark.sparkContext.applicationId, sf_dir, "packed"
    if key not in _INDEXES:
        path = scratch(spark, "packed")
        pack(index(spark, sf_dir)).write.parquet(path)
        _INDEXES[key] = spark.read.parquet(path)
    return _INDEXES[key]


UNITS = (
    DOCS
    + """, units AS (
  SELECT doc_id, title, issuer, role, lang, CAST(pos AS INTEGER) AS pos, line, CAST(1 + (pos - 1) // 10 AS INTEGER) AS page,
    CAST(1 + (length(line) + pos) % 5 AS INTEGER) AS level
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM docs))"""
)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as units: pos from 1, page of ten lines, a level from 1 to 5."""
    lines = docs(spark, sf_dir).select("doc_id", "title", "issuer", "role", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    pos = (F.col("p") + 1).cast("int")
    return lines.select(
        "doc_id", "title", "issuer", "role", "lang", pos.alias("pos"), "line",
        (1 + F.floor((pos - 1) / 10)).cast("int").alias("page"), (1 + (F.length("line") + pos) % 5).cast("int").alias("level"),
    )


SEARCHES = (
    "searches AS (SELECT item_id AS search_id, array_to_string("
    + sql_tokens("text")
    + ", ' ') AS query, CASE item_id % 3 WHEN 1 THEN 'BI' WHEN 2 THEN 'OJK' END AS issuer FROM benchmark)"
)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each test item: all its tokens; two in three ask for an issuer."""
    from ..functions.text import tokens

    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("search_id"), F.array_join(tokens(F.col("text")), " ").alias("query"),
        F.when(F.col("item_id") % 3 == 1, "BI").when(F.col("item_id") % 3 == 2, "OJK").alias("issuer"),
    )


#: Postings, terms and statistics of the documents' texts.
INDEX = (
    DOCS
    + ", tok AS (SELECT doc_id, "
    + sql_tokens("text")
    + """ AS ts FROM docs), lens AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS doc_len FROM tok),
postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens)"""
)

#: Terms of the searches with their candidates, and BM25 of every hit; {filter} and {least} are filled in.
BM25 = (
    INDEX
    + ", "
    + SEARCHES
    + ", st AS (SELECT search_id, term, count(*) AS qf FROM (SELECT search_id, unnest("
    + sql_tokens("query")
    + """) AS term FROM searches) GROUP BY search_id, term),
ranked AS (SELECT st.*, df, row_number() OVER (PARTITION BY search_id ORDER BY coalesce(df, 1000000000), st.term) AS rk FROM st LEFT JOIN terms USING (term)),
cand AS (SELECT *, CASE WHEN count(*) FILTER (rk <= 6) OVER (PARTITION BY search_id) >= 3 THEN 2 ELSE 1 END AS min_match FROM ranked),
hits AS (
  SELECT search_id, p.doc_id, count(*) FILTER (rk <= 6) AS matched, any_value(min_match) AS min_match,
    sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (0.25 + 0.75 * greatest(doc_len, 1) / avg_len)) * qf) AS bm25
  FROM cand JOIN postings p USING (term) JOIN lens USING (doc_id) JOIN docs d USING (doc_id) JOIN searches s USING (search_id), stats
  WHERE {filter} GROUP BY search_id, p.doc_id)"""
)
