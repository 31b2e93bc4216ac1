"""Incremental index: new documents arrive as files, each batch is indexed by itself and published as a version.

Postings and documents are immutable and only added to; counts of terms and lengths are merged when read. A version is a
directory that is written whole before the pointer file names it, so readers never see half of one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, append, build, read, write
from ..sources.files import write_pointer


def signature(settings: Mapping, stopwords=()) -> str:
    """Identity of what an index was built with; another one asks for a rebuild."""
    return hashlib.sha1(json.dumps([dict(settings), sorted(stopwords)], sort_keys=True).encode()).hexdigest()


def _pointer(root: str, spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict | None:
    """{"versions": [...], "signature": ...} or None before the first version."""
    path, fs = _pointer(root, spark)
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, state: dict) -> None:
    write_pointer(spark, f"{root}/CURRENT", json.dumps(state))


def add(spark: SparkSession, root: str, docs: DataFrame, name: str, sign: str, weights=None) -> None:
    """Indexes docs as version `name`, unless that version is there (a repeated batch)."""
    state = current(spark, root) or {"versions": [], "signature": sign}
    if state["signature"] != sign:
        raise ValueError("the index was built with other settings: rebuild it")
    if name in state["versions"]:
        return
    write(build(docs, weights=weights), f"{root}/{name}")
    publish(spark, root, {"versions": [*state["versions"], name], "signature": sign})


def load(spark: SparkSession, root: str) -> Index:
    """All versions as one index."""
    out = None
    for name in (current(spark, root) or {"versions": []})["versions"]:
        part = read(spark, f"{root}/{name}")
        out = part if out is None else append(out, part)
    if out is None:
        raise FileNotFoundError(f"no index under {root}")
    return out


def follow(stream: DataFrame, root: str, checkpoint: str, sign: str, weights=None):
    """Indexes a stream of documents batch by batch; a batch that is run again after a failure finds its version there."""

    def batch(docs: DataFrame, number: int) -> None:
        if not docs.isEmpty():
            add(docs.sparkSession, root, docs, f"batch-{number:08d}", sign, weights)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(docs: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    return docs.join(index.docs.select(F.col(key)), key, "left_anti")
