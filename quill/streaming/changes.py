"""A stored index that changes: documents are added, replaced and deleted, and what is dead is cleared away over time.

A change is written as a run, which is never altered: its documents and postings, the ids that it makes `gone` from the
runs before it, and by how much it alters each term's count of documents. Runs of one level are merged into one of the next
as soon as there are `fan` of them, without the rows that later ones of them have made gone, so that n changes leave at most
(fan - 1) * (1 + log n to the base fan) runs, and a row is written again once a level. A pointer file names the runs; it is
replaced after what it names is whole, so readers see the index before a change or after it. There is one writer at a time.

A document is one row: of several rows of a change with one id, the greatest counts (by its columns in order). An id that a
change both has and deletes is there after it; deleting an id that isn't there does nothing. A null id is an error."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, weighted_tokens, with_counts
from ..sources.files import write_pointer
from .ingest import current

#: Up to so many ids are broadcast to drop dead rows; beyond it Spark joins by a shuffle where it must.
BROADCAST_IDS = 1_000_000


def change(
    spark: SparkSession, root: str, number: int, sign: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None,
    key: str = "doc_id", weights: Mapping[str, int] | None = None, stopwords: Sequence[str] = (), fan: int = 2, buckets: int = 64,
) -> None:
    """Applies change `number` unless it, or a later one, has been applied (a batch that is run again). upserts: documents
    to add or to put in the place of those with their ids; deletes: ids. buckets: in how many hash partitions of the term a
    run's postings lie, as the first change says."""
    state = current(spark, root) or {"signature": sign, "last": -1, "key": key, "buckets": buckets, "runs": []}
    if state["signature"] != sign or state["key"] != key:
        raise ValueError("the index was built with other settings: rebuild it")
    if number <= state["last"]:
        return
    if upserts is None:
        if not state["runs"]:
            raise ValueError("the first change must have documents")
        upserts = spark.read.parquet(f"{root}/{state['runs'][0]['name']}/docs").drop("doc_len", "_terms", "_tf").limit(0)
    name = f"run-{uuid.uuid4().hex}"
    fields = dict(weights or {"text": 1})
    rest = [c for c in upserts.columns if c != key]
    checked = upserts.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("a document without an id"))).otherwise(F.col(key)))
    one = checked.groupBy(key).agg(F.max(F.struct(*rest)).alias("_d")).select(key, "_d.*")
    # texts are split into tokens once: the postings are made from the counts that the documents' rows are written with
    split = one.withColumn("_tokens", weighted_tokens(fields, stopwords)).withColumn("doc_len", F.size("_tokens").cast("long"))
    counted = with_counts(split).withColumns({"_terms": F.col("_counts.term"), "_tf": F.col("_counts.tf")}).drop("_counts")
    counted.sortWithinPartitions(key).write.parquet(f"{root}/{name}/docs")
    docs = spark.read.parquet(f"{root}/{name}/docs")
    listed = docs.select(key, F.explode(F.arrays_zip(F.col("_terms").alias("term"), F.col("_tf").alias("tf"))).alias("_r"))
    _write_postings(listed.select("_r.term", key, "_r.tf"), f"{root}/{name}/postings", key, state["buckets"])
    ids = docs.select(key) if deletes is None else docs.select(key).unionByName(deletes.select(F.col(key).cast(dict(docs.dtypes)[key])).dropna()).distinct()
    ids.write.parquet(f"{root}/{name}/gone")
    gone = spark.read.parquet(f"{root}/{name}/gone")
    n_gone = gone.count()
    altered = docs.select(F.lit(1).alias("_s"), "doc_len", "_terms")
    if state["runs"]:
        dead = visible(spark, root, state["runs"], "docs", key).join(_small(gone, n_gone), key, "left_semi")
        altered = altered.unionByName(dead.select(F.lit(-1).alias("_s"), "doc_len", "_terms"))
    deltas = altered.select("_s", F.explode("_terms").alias("term")).groupBy("term").agg(F.sum("_s").alias("df")).where("df <> 0")
    deltas.sortWithinPartitions("term").write.parquet(f"{root}/{name}/terms")
    sums = altered.agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_s") * F.col("doc_len")), F.lit(0)).alias("length")).first()
    run = {"name": name, "level": 0, "gone": n_gone, "rows": docs.count(), "docs": sums["n"], "length": sums["length"]}
    state = state | {"last": number, "runs": [*state["runs"], run]}
    write_pointer(spark, f"{root}/CURRENT", json.dumps(state))
    runs, level = due([r["level"] for r in state["runs"]], fan)
    if runs > 1:
        merge(spark, root, state, runs, level)


def due(levels: Sequence[int], fan: int) -> tuple[int, int]:
    """How many of the last runs are to be merged into one, and its level: whole levels at the end carry into the next."""
    taken, level = 1, levels[-1]
    while levels[-taken - fan + 1 :][: fan - 1] == [level] * (fan - 1) and taken + fan - 1 <= len(levels):
        taken, level = taken + fan - 1, level + 1
    return taken, level


def merge(spark: SparkSession, root: str, state: Mapping, runs: int, level: int) -> None:
    """Writes the last `runs` runs as one. Ids made gone are kept only while there are runs before it to hide rows of."""
    key, old, kept = state["key"], state["runs"][-runs:], state["runs"][:-runs]
    name = f"run-{uuid.uuid4().hex}"
    visible(spark, root, old, "docs", key).drop("_tf").sortWithinPartitions(key).write.parquet(f"{root}/{name}/docs")
    _write_postings(visible(spark, root, old, "postings", key), f"{root}/{name}/postings", key, state["buckets"])
    gone = _union(spark, root, old, "gone").distinct()
    (gone if kept else gone.limit(0)).write.parquet(f"{root}/{name}/gone")
    terms = _union(spark, root, old, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    terms.sortWithinPartitions("term").write.parquet(f"{root}/{name}/terms")
    run = {"name": name, "level": level, "docs": sum(r["docs"] for r in old), "length": sum(r["length"] for r in old)}
    run |= {n: spark.read.parquet(f"{root}/{name}/{t}").count() for n, t in (("gone", "gone"), ("rows", "docs"))}
    write_pointer(spark, f"{root}/CURRENT", json.dumps(dict(state) | {"runs": [*kept, run]}))


def visible(spark: SparkSession, root: str, runs: Sequence[Mapping], table: str, key: str) -> DataFrame:
    """Rows of a table of these runs that no later one of them has made gone. The last run's are not looked at twice, and
    the older a run, and so the larger, the more it is compared with ids alone, of runs that are smaller."""
    out = None
    for at, run in enumerate(runs):
        rows, later = spark.read.parquet(f"{root}/{run['name']}/{table}"), [r for r in runs[at + 1 :] if r["gone"]]
        if later:
            rows = rows.join(_small(_union(spark, root, later, "gone"), sum(r["gone"] for r in later)), key, "left_anti")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def load(spark: SparkSession, root: str) -> Index:
    """The index as it stands: what a build of the documents that are there would give, for any search."""
    state = current(spark, root)
    if not state or not state["runs"]:
        raise FileNotFoundError(f"no index under {root}")
    runs, key = state["runs"], state["key"]
    n, length = sum(r["docs"] for r in runs), sum(r["length"] for r in runs)
    terms = _union(spark, root, runs, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(length / n if n else None).cast("double").alias("avg_len"))
    postings = visible(spark, root, runs, "postings", key).select("term", key, "tf")
    return Index(visible(spark, root, runs, "docs", key).drop("_terms", "_tf"), postings, terms, stats)


def follow(stream: DataFrame, root: str, checkpoint: str, sign: str, deleted: str = "deleted", key: str = "doc_id", weights: Mapping[str, int] | None = None, fan: int = 2, buckets: int = 64):
    """Applies a stream of documents batch by batch; a row whose column `deleted` is true takes its document out. Of one
    batch's rows of an id, a document's counts before a deletion. A batch that is run again changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        away = F.coalesce(F.col(deleted), F.lit(False))
        change(rows.sparkSession, root, number, sign, rows.where(~away).drop(deleted), rows.where(away).select(key), key, weights, fan=fan, buckets=buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the runs that the pointer doesn't name, and returns their names: those that were merged and those that a
    writer left when it failed. Not while a change is being written, nor while a reader of an earlier pointer goes on."""
    named = {r["name"] for r in (current(spark, root) or {"runs": []})["runs"]}
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("run-") and s.getPath().getName() not in named]
    for p in found:
        fs.delete(p, True)
    return sorted(p.getName() for p in found)


def _union(spark: SparkSession, root: str, runs: Sequence[Mapping], table: str) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{r['name']}/{table}" for r in runs])


def _small(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def _write_postings(postings: DataFrame, path: str, key: str, buckets: int) -> None:
    postings.repartition(buckets, "term").sortWithinPartitions("term", key).write.parquet(path)
