"""Sources and sinks: what is written is read back. Files lie in the shared scratch folder."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import vectors as ve
from ..sources import files, pages, ranges, state
from ..streaming import changes
from .base import DOCS, INDEX, UNITS, docs, query, table, units
from .structure import PARSED, parsed_pages, shown

#: What five changes leave of the documents; see changed_index.
CHANGED = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 21 = 0 THEN concat_ws(' ', title, lang) WHEN doc_id % 3 = 0 THEN text ELSE title END AS text
FROM docs WHERE doc_id % 7 <> 0 OR doc_id % 21 = 0 OR doc_id % 5 = 0"""
PART = "p_partkey long, p_name string, p_brand string, p_size int"


def _lines(df):
    """Rows as JSON lines, with an empty line after each."""
    return df.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value"))


@query("SELECT p_partkey, p_name, p_brand, CAST(p_size AS INTEGER) AS p_size FROM part")
def ndjson_scan(spark, sf_dir):
    """JSON lines with empty lines between, read with a schema; a missing file adds nothing."""
    path = files.scratch(spark, "lines")
    _lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")).write.text(path)
    return files.read_ndjson(spark, path, PART).unionByName(files.read_ndjson(spark, f"{path}-absent", PART, missing_ok=True))


@query("SELECT 'a' AS source, p_partkey AS record, CAST(0 AS INTEGER) AS file_index, p_brand AS kind, p_name AS saved_path FROM part UNION ALL SELECT 'a', p_partkey, 1, NULL, p_type FROM part UNION ALL SELECT 'b', n_nationkey, 0, 'tab', n_name FROM nation")
def record_files(spark, sf_dir):
    """Records of three sources, one as JSON lines, one as whole files, one absent: a row for each of their files."""
    root = files.scratch(spark, "records")
    f = F.array(F.struct(F.col("p_brand").alias("kind"), F.col("p_name").alias("saved_path")), F.struct(F.lit(None).cast("string").alias("kind"), F.col("p_type").alias("saved_path")))
    many = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("title"), f.alias("files"))
    _lines(many).write.text(f"{root}/a/records.ndjson")
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("title"), F.lit("tab").alias("tab_name"), F.struct(F.col("n_name").alias("saved_path")).alias("file"))
    for title, text in one.select("title", F.to_json(F.struct("*"))).collect():  # a file for each of the 25 nations
        files.write_pointer(spark, f"{root}/b/{title}.json", text)
    entries = files.file_entries(files.read_records(spark, root, ["a", "b", "absent"]))
    return entries.select("source", F.get_json_object("payload", "$.title").cast("long").alias("record"), F.col("file_index").cast("int").alias("file_index"), "kind", "saved_path")


@query(f"WITH {INDEX} SELECT term, df, n_docs, (SELECT count(*) FROM postings) AS n_postings, true AS whole, false AS torn, true AS current, false AS stale FROM terms, stats")
def stored_index(spark, sf_dir):
    """An index written and read back; whether it is whole, and built from what it says it is."""
    root = files.scratch(spark, "stored")
    ix.write(ix.build(docs(spark, sf_dir)), f"{root}/index")
    now = state.signature(spark, [f"{sf_dir}/documents.parquet"], ["yang"], {"title": 3})
    state.write_state(spark, f"{root}/STATE", {"signature": now})
    got = ix.read(spark, f"{root}/index")
    checks = {
        "whole": state.complete(spark, f"{root}/index"), "torn": state.complete(spark, f"{root}/absent"), "current": state.is_current(spark, f"{root}/index", f"{root}/STATE", now),
        "stale": state.is_current(spark, f"{root}/index", f"{root}/STATE", state.signature(spark, [f"{sf_dir}/documents.parquet"], ["lain"], {"title": 3})),
    }
    n = got.postings.agg(F.count(F.lit(1)).alias("n_postings"))
    rows = got.terms.crossJoin(F.broadcast(got.stats.select("n_docs"))).crossJoin(F.broadcast(n))  # one row each
    return rows.select("term", "df", "n_docs", "n_postings", *[F.lit(v).alias(k) for k, v in checks.items()])


@query(
    "WITH "
    + INDEX.replace("FROM docs), lens", f"FROM ({CHANGED}) AS changed), lens")
    + " SELECT term, df, n, tf, CAST(n_docs AS BIGINT) AS n_docs, round(avg_len, 6) AS avg_len FROM terms JOIN (SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM postings GROUP BY term) USING (term), stats"
)
def changed_index(spark, sf_dir):
    """Five changes of an index: titles alone, texts for a third, a seventh taken out, a third of those put back, texts for a
    fifth. Counts of terms as the changes keep them, and as the postings that are left give them."""
    root, d, i = files.scratch(spark, "changed"), docs(spark, sf_dir), F.col("doc_id")
    titles, titled = d.select("doc_id", F.col("title").alias("text")), d.select("doc_id", F.concat_ws(" ", "title", "lang").alias("text"))
    steps = [(titles, None), (d.where(i % 3 == 0), None), (None, d.where(i % 7 == 0)), (titled.where(i % 21 == 0), None), (d.where(i % 5 == 0), None)]
    for number, (new, away) in enumerate(steps):
        changes.change(spark, root, number, "plain", new if new is None else new.select("doc_id", "text"), away, buckets=8)
    got = changes.load(spark, root)
    counted = got.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    return got.terms.join(counted, "term", "full").crossJoin(F.broadcast(got.stats)).select("term", "df", "n", "tf", "n_docs", F.round("avg_len", 6).alias("avg_len"))  # one row of statistics


def _grown(spark, root, rows, late):
    """Rows (key, value, late) as files of lines below root, those of the second load after those of the first: with the same
    rows in the first load, each file begins with the bytes that it has without a second."""
    kept = rows if late else rows.where("NOT late")
    kept.repartition(4, "key").sortWithinPartitions("late", "key").select("value").write.text(root)
    return ranges.listed(spark, root).where("path LIKE '%part-%'").select(F.regexp_extract("path", r"part-(\d+)", 1).alias("name"), "path", "length")


@query(
    """SELECT p_partkey, p_brand AS issuer, 'append' AS verdict, 'rebuild' AS shrunk, 'rebuild' AS changed, 'current' AS same FROM part WHERE p_size > 25 AND lower(p_brand) = 'brand#12'"""
)
def appended_rows(spark, sf_dir):
    """A corpus of files that grew: the verdicts on it and on its other fates, from trees of digests, and the rows after the
    old ends, of one issuer, read by byte ranges."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.to_json(F.struct("p_partkey", F.col("p_brand").alias("issuer"))).alias("value"), (F.col("p_size") > 25).alias("late"))
    path, size = files.scratch(spark, "corpus"), 4096
    fates = {
        "same": _grown(spark, f"{path}/same", p, False), "verdict": _grown(spark, f"{path}/grown", p, True), "shrunk": _grown(spark, f"{path}/shrunk", p.where("late OR key % 5 > 0"), False),
        "changed": _grown(spark, f"{path}/changed", p.withColumn("value", F.regexp_replace("value", "Brand#11", "Brand#99")), True),
    }
    before = fates["same"]
    old = ranges.tree(ranges.pieces(before, size), f"{path}/tree")
    worst = F.max_by("verdict", F.array_position(F.array(*map(F.lit, ("current", "append", "rebuild"))), F.col("verdict")))
    said = {name: ranges.verdicts(before, old, now, size).agg(worst).first()[0] for name, now in fates.items()}
    added = fates["verdict"].join(before.select("name", F.col("length").alias("start")), "name", "left").fillna(0, ["start"])
    good, _ = ranges.records(ranges.lines(ranges.pieces(added, size)), "p_partkey long, issuer string")
    return good.where("lower(issuer) = 'brand#12'").select("p_partkey", "issuer", *[F.lit(v).alias(k) for k, v in said.items()])


@query("SELECT CAST(p_size AS INTEGER) AS p_size, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS size, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS sha256 FROM part GROUP BY 1 UNION ALL SELECT -1, NULL, NULL")
def file_digests(spark, sf_dir):
    """Digests of files, read in pieces: the names of the parts of each size, and one that isn't there."""
    root = files.scratch(spark, "digests")
    names = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("p_size"), "p_partkey", "p_name")
    names.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_size", F.col("p_name").alias("value")).write.partitionBy("p_size").text(root)
    there = ranges.listed(spark, root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("p_size"))
    listed = there.unionByName(spark.createDataFrame([(f"{root}/absent", -1)], "path string, p_size int"))
    return listed.join(state.chunked_digests(listed), "path").select("p_size", "size", "sha256")


@query(
    """WITH l AS (SELECT o_orderpriority AS name, o_orderkey, o_totalprice > 300000 AS changed, strlen(CAST(o_orderkey AS VARCHAR)) AS k, strlen(o_orderkey || ',' || o_custkey) + 1 AS n FROM orders),
c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY o_orderkey) - n + k AS mark_at FROM l) SELECT name, CAST(sum(n) AS BIGINT) AS size, CAST(min(mark_at) FILTER (changed) // 256 AS BIGINT) AS number FROM c GROUP BY name"""
)
def changed_pieces(spark, sf_dir):
    """Orders as a file of lines for each priority, and again with another mark in some lines: the first piece of 256 bytes
    in which the trees of digests differ."""
    root, o = files.scratch(spark, "trees"), table(spark, sf_dir, "orders")
    trees, sizes = [], None
    for name, mark in (("before", F.lit(",")), ("after", F.when(F.col("o_totalprice") > 300000, ";").otherwise(","))):
        line = o.select("o_orderpriority", "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), mark, F.col("o_custkey").cast("string")).alias("value"))
        line.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey").select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(f"{root}/{name}")
        found = ranges.listed(spark, f"{root}/{name}").select(F.regexp_extract("path", r"o_orderpriority=(\d)", 1).alias("name"), "path", "length")
        trees.append(ranges.tree(ranges.pieces(found.where("name <> ''"), 256), f"{root}/{name}-tree", fan=16))
        sizes = found
    first = ranges.first_changed(*trees, fan=16)
    full = o.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("full"), F.left("o_orderpriority", F.lit(1)).alias("name"))
    return first.join(sizes.select("name", F.col("length").alias("size")), "name").join(full, "name").select(F.col("full").alias("name"), "size", "number")


@query("SELECT p_partkey, p_name AS block FROM part")
def stored_blocks(spark, sf_dir):
    """Blocks as stored: compressed, or plain where an older store wrote them."""

    @F.pandas_udf("binary")
    def packed(names: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(n.encode(), 1) if k % 2 else n.encode() for n, k in zip(names, keys, strict=True)])

    stored = table(spark, sf_dir, "part").select("p_partkey", packed("p_name", "p_partkey").alias("raw"))
    return stored.select("p_partkey", state.decoded_json(F.col("raw")).alias("block"))


VECTORS = """n AS (SELECT doc_id, length(title) AS a, length(text) AS b FROM docs), v AS (SELECT doc_id, a / sqrt(a * a + b * b + 1.0) AS x, b / sqrt(a * a + b * b + 1.0) AS y, 1 / sqrt(a * a + b * b + 1.0) AS z FROM n)"""


@query(f"WITH {DOCS}, {VECTORS} SELECT doc_id, issuer, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 4) AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS z FROM v JOIN docs USING (doc_id)")
def stored_vectors(spark, sf_dir):
    """Documents encoded (by a model that counts characters), stored and scanned."""
    root = files.scratch(spark, "vectors")
    made = {"model": "lengths", "normalize": True}
    text = docs(spark, sf_dir).select("doc_id", "issuer", F.concat_ws("\u0001", "title", "text").alias("text"))
    coded = ve.encode(text, lambda ts: np.array([[len(t.split("\u0001")[0]), len(t.split("\u0001")[1]), 1.0] for t in ts])).drop("text")
    ve.write_vectors(coded, root, made)
    return ve.read_vectors(spark, root, made).select("doc_id", "issuer", *[F.round(F.col("embedding")[k].cast("double"), 4).alias(n) for k, n in enumerate("xyz")])


@query(
    f"""WITH {PARSED} SELECT CAST(doc_id AS VARCHAR) AS file_id, node_id, unit_type, shown AS display_text FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'enumeration_aggregate', listed FROM z WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def rebuilt_units(spark, sf_dir):
    """Units derived anew from stored raw pages; files on the list of those that need OCR (here: toxic ones) stay out. A row
    of the list that doesn't say which file it means may mean any, so with one, as by SQL's NOT IN, all stay out."""
    root = files.scratch(spark, "raw")
    text = parsed_pages(units(spark, sf_dir))
    pages.write_raw(text.select("file_id", pages.page_row(F.col("page_num"), F.col("text")).alias("page")), f"{root}/pages")
    excluded = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("file_id"))
    rows = pages.rebuild_units(spark, f"{root}/pages", f"{root}/units", excluded.where("file_id IS NOT NULL"))
    rows = rows.join(F.broadcast(excluded.where("file_id IS NULL").limit(1)), F.lit(True), "left_anti")  # one row at most
    return rows.select("file_id", F.when(F.col("unit_type") != "enumeration_aggregate", F.col("node_id")).alias("node_id"), "unit_type", shown(F.col("display_text")).alias("display_text"))


@query(
    f"""WITH {UNITS} SELECT doc_id, pos, left(trim(regexp_replace(lower(issuer || ' ' || line), '[^a-z0-9]+', '-', 'g'), '-'), 160) || '-' || left(sha1(issuer || ' ' || line), 12) || '.json' AS name FROM units"""
)
def raw_names(spark, sf_dir):
    """Names for the raw pages of files: a slug of bounded length and a hash."""
    return units(spark, sf_dir).select("doc_id", "pos", pages.raw_name(F.concat_ws(" ", "issuer", "line")).alias("name"))
