"""Files by byte ranges: JSON lines after an offset with a table of rejects, as a batch or a stream, and trees of digests that
tell which piece of a file changed. Bytes are read by tasks alone, through file systems that pyarrow opens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import scratch

PIECE = 64 << 20
READ = 1 << 20


def _fs(path: str):
    """The file system of a path as Spark lists it (nothing in it is escaped), and the path there."""
    import pyarrow.fs

    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, mark, rest = path.partition("://")
    return pyarrow.fs.FileSystem.from_uri(scheme + mark + quote(rest, safe="/:@") if mark else path)


def lines_between(path: str, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin at start or later and before stop; empty ones are left out. A range may begin
    and end anywhere: a line belongs to the range that its first byte lies in. Holds one line and READ bytes."""
    fs, name = _fs(path)
    skipping = start > 0
    base, held = max(start - 1, 0), bytearray()
    with fs.open_input_file(name) as f:
        f.seek(min(base, f.size()))
        while piece := f.read(READ):
            seen, begin = len(held), 0
            held += piece
            while (end := held.find(b"\n", max(seen, begin))) >= 0:
                if not skipping:
                    if base + begin >= stop:
                        return
                    if line := bytes(held[begin:end]).strip():
                        yield base + begin, line.decode("utf-8", "replace")
                skipping, begin = False, end + 1
            del held[:begin]
            base += begin
        if held.strip() and not skipping and base < stop:
            yield base, bytes(held).strip().decode("utf-8", "replace")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files below root; empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def pieces(files: DataFrame, size: int = PIECE, tasks: int | None = None) -> DataFrame:
    """files: name, path, length, and start if they aren't read from the beginning. (name, path, number, start, stop),
    dealt out to tasks whatever file they are of; an empty file has none."""
    begin = F.col("start") if "start" in files.columns else F.lit(0)
    last = F.floor((F.col("length") - begin - 1) / size)
    rows = files.where(F.col("length") > begin).select("name", "path", "length", begin.cast("long").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("number"))
    start = F.col("_b") + F.col("number") * size
    out = rows.select("name", "path", "number", start.alias("start"), F.least(start + size, "length").alias("stop"))
    return out.repartition(tasks or 4 * files.sparkSession.sparkContext.defaultParallelism, "name", "number")


def lines(ranges: DataFrame) -> DataFrame:
    """(name, offset, line) of pieces()."""
    kind = dict(ranges.dtypes)["name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                held, size = [], 0
                for offset, line in lines_between(r.path, r.start, r.stop):
                    held.append((r.name, offset, line))
                    size += len(line)
                    if size > READ:
                        yield pd.DataFrame(held, columns=["name", "offset", "line"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["name", "offset", "line"])

    return ranges.select("name", "path", "start", "stop").mapInPandas(run, f"name {kind}, offset long, line string")


def records(rows: DataFrame, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows with the record's columns in place of `line`, and those whose line isn't an object of this schema."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = rows.withColumn("_r", parsed).withColumn("_ok", F.col("line").startswith("{") & F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    rest = [c for c in rows.columns if c != "line" and c not in schema.names]
    return read.where("_ok").select(*rest, *[F.col(f"_r.`{c}`").alias(c) for c in schema.names]), read.where("NOT _ok").select(*rest, "line")


class LineRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(0)
        self.path, self.start, self.stop = path, start, stop


class LineRanges(DataSource):
    """format("line_ranges"): (offset, line) of one file. Options: path, start (0), piece (bytes of a task). As a stream it
    gives whole lines alone: what follows the last line end waits for the next batch."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Ranges:
    def __init__(self, options):
        self.path, self.first, self.piece = options["path"], int(options.get("start", 0)), int(options.get("piece", PIECE))

    def cut(self, start: int, stop: int) -> list[LineRange]:
        return [LineRange(self.path, a, min(a + self.piece, stop)) for a in range(start, stop, self.piece)]

    def read(self, partition: LineRange) -> Iterator[tuple[int, str]]:
        return lines_between(partition.path, partition.start, partition.stop)

    def size(self) -> int:
        fs, name = _fs(self.path)
        return fs.get_file_info(name).size or 0


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[LineRange]:
        return self.cut(self.first, self.size())


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"byte": self.first}

    def latestOffset(self) -> dict:
        """After the last line end: looked for from the end backwards."""
        fs, name = _fs(self.path)
        with fs.open_input_file(name) as f:
            end = f.size()
            while end > self.first:
                begin = max(self.first, end - READ)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return {"byte": begin + at + 1}
                end = begin
        return {"byte": self.first}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return self.cut(start["byte"], end["byte"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineRanges)


def tree(ranges: DataFrame, path: str, fan: int = 1024) -> DataFrame:
    """(name, level, number, sha256): level 0 has the digest of each of pieces(), a level's rows the digest of the joined
    digests of up to `fan` rows below, and the last level one row a name. Each level is written below path and read by the next, so bytes are
    read once."""
    kind = dict(ranges.dtypes)["name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                fs, name = _fs(r.path)
                digest, left = hashlib.sha256(), r.stop - r.start
                with fs.open_input_file(name) as f:
                    f.seek(r.start)
                    while left > 0 and (piece := f.read(min(READ, left))):
                        digest.update(piece)
                        left -= len(piece)
                out.append((r.name, r.number, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["name", "number", "sha256"])

    def written(rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{path}/level={depth}")
        return ranges.sparkSession.read.parquet(f"{path}/level={depth}")

    depth = 0
    level = written(ranges.mapInPandas(run, f"name {kind}, number long, sha256 string"))
    most = level.agg(F.max("number")).first()[0] or 0
    while most > 0:
        depth, most = depth + 1, most // fan
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "sha256"))), lambda x: x["sha256"]), "")  # at most `fan` of them
        rows = level.groupBy("name", F.floor(F.col("number") / fan).cast("long").alias("up")).agg(F.sha2(joined, 256).alias("sha256"))
        level = written(rows.select("name", F.col("up").alias("number"), "sha256"))
    return read_tree(ranges.sparkSession, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", F.col("level").cast("int").alias("level"), "number", "sha256")


def first_changed(before: DataFrame, after: DataFrame, fan: int = 1024) -> DataFrame:
    """(name, number): the first piece in which two written trees of names that both have differ, null if in none. Below the
    tops only children of nodes that differ are compared; a piece that one of them lacks differs."""
    names = before.select("name").distinct().join(after.select("name").distinct(), "name")
    levels = [t.agg(F.max("level")).first()[0] or 0 for t in (before, after)]
    b, a = before.withColumnRenamed("sha256", "_b"), after.withColumnRenamed("sha256", "_a")
    differ = None
    for level in range(max(levels), -1, -1):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (b, a))
        if differ is not None:
            up = F.floor(F.col("number") / fan).cast("long")
            x, y = (t.withColumn("_up", up).join(differ, ["name", "_up"], "left_semi").drop("_up") for t in (x, y))
        both = x.join(y, ["name", "number"], "full").where(~F.col("_b").eqNullSafe(F.col("_a"))).join(names, "name", "left_semi")
        differ = both.select("name", F.col("number").alias("_up"))
    return names.join(differ.groupBy("name").agg(F.min("_up").alias("number")), "name", "left")


def verdicts(before: DataFrame, old: DataFrame, now: DataFrame, size: int = PIECE) -> DataFrame:
    """(name, verdict, number) of files by what they were: before (name, length) and its written tree `old`, of pieces of
    `size` bytes; now: name, path, length. "rebuild": a file is gone, shorter, or has other bytes where it was, from piece
    `number` on; "append": it has grown or is new; "current". Bytes after the old end aren't read."""
    b = before.select("name", F.col("length").alias("_was"))
    still = now.join(b, "name").where(F.col("length") >= F.col("_was")).select("name", "path", F.col("_was").alias("length"))
    changed = first_changed(old, tree(pieces(still, size), scratch(now.sparkSession, "tree")))
    both = b.join(now.select("name", "length"), "name", "full").join(changed, "name", "left")
    lost = F.col("_was").isNotNull() & (F.col("length").isNull() | (F.col("length") < F.col("_was")))
    verdict = F.when(lost | F.col("number").isNotNull(), "rebuild").when(F.col("_was").isNull() | (F.col("length") > F.col("_was")), "append").otherwise("current")
    return both.select("name", verdict.alias("verdict"), F.when(~lost, F.col("number")).alias("number"))
