"""What a corpus file was when it was indexed, and what has happened to it since: digests, sizes, appended rows.

Bytes are read by the JVM through Hadoop's file systems, so any path that Spark reads will do; nothing is held whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists
from .ranges import lines, pieces

CHUNK = 1 << 20


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, p, fs.getFileStatus(p) if fs.exists(p) else None


def prefix_digest(spark: SparkSession, path: str, length: int) -> str:
    """SHA-1 of the first `length` bytes, or of all if there are fewer."""
    fs, p, status = _status(spark, path)
    length = min(length, status.getLen())
    java = spark._jvm.java
    digest = java.security.MessageDigest.getInstance("SHA-1")
    out = java.security.DigestOutputStream(java.io.OutputStream.nullOutputStream(), digest)
    stream = fs.open(p)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, length)
    finally:
        stream.close()
    return bytes(digest.digest()).hex()


def file_state(spark: SparkSession, path: str) -> dict:
    """{path, size, sha1}; size and sha1 are None for a file that isn't there."""
    _, _, status = _status(spark, path)
    if status is None:
        return {"path": path, "size": None, "sha1": None}
    return {"path": path, "size": status.getLen(), "sha1": prefix_digest(spark, path, status.getLen())}


def signature(spark: SparkSession, artifacts: Sequence[str], stopwords: Iterable[str] = (), settings: dict | None = None) -> dict:
    """What an index depends on: time and size of each artifact (None if it isn't there), stop words and settings."""
    stat = [_status(spark, a)[2] for a in artifacts]
    return {
        "artifacts": {a: [s.getModificationTime(), s.getLen()] if s else None for a, s in zip(artifacts, stat, strict=True)},
        "stopwords_sha1": hashlib.sha1("\n".join(sorted(stopwords)).encode()).hexdigest(), "settings": settings or {},
    }


def change(spark: SparkSession, path: str, before: dict | None) -> tuple[str, str]:
    """("current" | "append" | "rebuild", why): whether path is what it was, has grown at its end, or is another file."""
    _, _, status = _status(spark, path)
    if status is None:
        return "rebuild", "the corpus is missing"
    if not before or before.get("path") != path or before.get("size") is None:
        return "rebuild", "no state of this file is known"
    if status.getLen() < before["size"]:
        return "rebuild", "the corpus shrank"
    if prefix_digest(spark, path, before["size"]) != before["sha1"]:
        return "rebuild", "bytes that were indexed have changed"
    return ("current", "nothing was added") if status.getLen() == before["size"] else ("append", f"{status.getLen() - before['size']} bytes were added")


def read_from_offset(spark: SparkSession, path: str, offset: int, schema, issuer: str | None = None, role: str | None = None, source: str | None = None) -> DataFrame:
    """The NDJSON records after `offset` bytes, which ends a line, of these issuer, role and source. Byte ranges are read by
    tasks, up to the length that the file has now; a line that isn't such a record is an error."""
    _, _, status = _status(spark, path)
    one = spark.createDataFrame([(path, path, status.getLen(), offset)], "name string, path string, length long, start long")
    rows = lines(pieces(one)).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    for name, value in (("issuer", issuer), ("role", role), ("source", source)):
        if value is not None:
            rows = rows.where(F.lower(name) == value.lower() if name == "issuer" else F.col(name) == value)
    return rows


def complete(spark: SparkSession, root: str, tables: Sequence[str] = ("docs", "postings", "terms", "stats")) -> bool:
    """Whether an index was written to its end: every table has its marker, and there are as many documents as its statistics say."""
    if not all(exists(spark, f"{root}/{t}/_SUCCESS") for t in tables):
        return False
    said = spark.read.parquet(f"{root}/stats").first()
    return said is not None and said["n_docs"] == spark.read.parquet(f"{root}/docs").count()


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    from .files import write_pointer

    write_pointer(spark, path, json.dumps(state, sort_keys=True))


def read_state(spark: SparkSession, path: str) -> dict:
    """The key and value metadata of an index; empty if there is none."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else {}


def is_current(spark: SparkSession, root: str, state_path: str, now: dict) -> bool:
    """Whether the index at root is whole and was built from what `now`, a signature(), says."""
    return complete(spark, root) and read_state(spark, state_path).get("signature") == json.loads(json.dumps(now))


def chunked_digests(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, size, sha256) of files, read in pieces of 1 MiB where the rows lie: a file of any size takes one piece of memory.
    Paths are URIs of file systems that pyarrow opens. A file that isn't there has null for both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        for pdf in batches:
            out = []
            for path in pdf[column]:
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                if fs.get_file_info(name).type != pyarrow.fs.FileType.File:
                    out.append((path, None, None))
                    continue
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(name) as f:
                    while piece := f.read(CHUNK):
                        digest.update(piece)
                        size += len(piece)
                out.append((path, size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "size", "sha256"]).astype({"size": "Int64"})

    return paths.select(column).mapInPandas(run, "path string, size long, sha256 string")


def decoded_json(c: Column) -> Column:
    """The JSON text of a stored block: zlib-compressed bytes, or plain bytes as older stores have them."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        import zlib

        def one(v) -> str | None:
            if v is None:
                return None
            try:
                return zlib.decompress(bytes(v)).decode()
            except zlib.error:
                return bytes(v).decode()

        return values.map(one)

    return decode(c)
