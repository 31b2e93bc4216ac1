"""Shared helpers: table access, scratch tables in the cluster's shared folder, word splitting, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Python workers get at most so many bytes at once, if the session doesn't ask for less: rows hold whole texts, and both
#: the executor (outside its heap) and the worker hold a batch of each task several times over.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_setting(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of a batch for Python workers to BATCH_BYTES."""
    if not 0 < byte_setting(spark, BATCH) <= BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def words(text: str | bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D; bytes.split() splits on exactly these."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder the cluster names; only a local session (tests) may be without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quill-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df to the shared folder (options: the writer's) and reads it back: later plans start from files that outlive
    any executor, and the shuffles that made them are deleted at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    bound_batches(spark)
    before = spark.conf.get(CLEANUP, "false")
    df = df.select("*")  # a plan of its own, made under the setting
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a task holds few texts as Python objects at a time; at their end the worker, which
    waits for other tasks then, gives its free memory back."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory that the allocators of this process keep; where the C library can't, it is kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def discard(table: DataFrame) -> None:
    """Deletes what materialize() wrote, once no later plan reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_splits(df: DataFrame) -> int:
    """How many input splits the scan of df has: a measure of its size that needs no pass over it."""
    return max(1, df.rdd.getNumPartitions())


def split_bytes(spark: SparkSession) -> int:
    """The bytes of input files that a split of a scan has at most."""
    return byte_setting(spark, "spark.sql.files.maxPartitionBytes")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, share: int = 200) -> DataFrame:
    """rows joined with per_key, which has one row a key and the number n of its rows. Keys with over one in `share` of all
    rows, of which there are fewer than `share`, are broadcast, so that their rows meet them where they lie."""
    total = per_key.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / share
    few = F.broadcast(per_key.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(per_key.where(~hot), key)
    return rows.join(few, key).select(rest.columns).union(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a, b of one orderable type, in any direction; nulls and loops are ignored. Returns (node, root)
    for every node with an edge, root being the smallest node reachable. Each round is two joins of the edges with one
    row per node, so hubs are split by adaptive skew joins, and its result is a table in the shared folder.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = materialize(oriented(edges.select("a", "b")), "edges")
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialize(oriented(small), "small")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Forest:
    """Union-find over hashable items; keeps the pairs that joined two trees, so all pairs are never emitted."""

    def __init__(self):
        self.parent = {}
        self.kept = []

    def find(self, x):
        root = x
        while (p := self.parent.setdefault(root, root)) != root:
            root = p
        while (p := self.parent[x]) != root:
            self.parent[x] = root
            x = p
        return root

    def join(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.parent[hi] = lo
            self.kept.append((x, y) if x < y else (y, x))
