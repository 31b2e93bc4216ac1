"""Readers with declared schemas, file listings with digests, and sinks that publish whole directories."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Whole-file JSON."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_words(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """Stop words from a file of a word a line, in lower case; empty lines and those that begin with # don't count. The
    list goes into expressions, so a file of more than `most` words is refused."""
    word = F.lower(F.trim("value"))
    rows = spark.read.text(path).select(word.alias("w")).where((F.col("w") != "") & ~F.col("w").startswith("#")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has over {most} words")
    return sorted(r["w"] for r in rows)


def read_lexicon(spark: SparkSession, path: str) -> dict:
    """The planner's lexicon from a JSON file; a section that isn't there is empty."""
    text = spark.read.text(path, wholetext=True).first()
    sections = {name: [] for name in ("intents", "issuers", "entities", "topics")}
    return sections | (json.loads(text[0]) if text else {})


def read_ndjson(spark: SparkSession, path: str, schema, missing_ok: bool = False) -> DataFrame:
    """A record a line, blank lines skipped, bad lines fail. A missing file is an error, or empty if missing_ok."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, root: str, sources: list[str]) -> DataFrame:
    """(source, path, payload) of several sources: records.ndjson if there, else all *.json files; payload is the JSON text."""
    out = None
    for s in sources:
        lines = f"{root}/{s}/records.ndjson"
        if exists(spark, lines):
            one = spark.read.text(lines).where(F.trim("value") != "")
        elif exists(spark, f"{root}/{s}"):
            one = spark.read.option("pathGlobFilter", "*.json").text(f"{root}/{s}", wholetext=True)
        else:
            continue
        one = one.select(F.lit(s).alias("source"), F.input_file_name().alias("path"), F.col("value").alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "source string, path string, payload string")


def file_entries(records: DataFrame) -> DataFrame:
    """A row for each file of a record: its files, else its one file with the tab's name as kind."""
    entry = "struct<kind:string,label:string,content_type:string,source_url:string,final_url:string,saved_path:string>"
    many = F.from_json(F.get_json_object("payload", "$.files"), f"array<{entry}>")
    one = F.from_json(F.get_json_object("payload", "$.file"), entry)
    kind = F.coalesce(one["kind"], F.get_json_object("payload", "$.tab_name"), F.lit("file"))
    files = F.coalesce(many, F.when(one.isNotNull(), F.array(one.withField("kind", kind))))
    return records.select("source", "path", "payload", F.posexplode(files).alias("file_index", "file")).select("source", "path", "payload", "file_index", "file.*")


def list_files(spark: SparkSession, root: str, digests: bool = False) -> DataFrame:
    """(path, basename, size[, sha256]) of all files below root; content is read for digests alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cols = ["path", F.regexp_extract("path", r"([^/]+)$", 1).alias("basename"), F.col("length").alias("size")]
    return f.select(*cols, *([F.sha2("content", 256).alias("sha256")] if digests else []))


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that the cluster names. Only a local session may be without one; it gets a folder
    of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quill-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}/{tag}"


def replace(spark: SparkSession, temp: str, path: str) -> None:
    """Renames temp to path. What was there is put back if that fails; between the two renames there is nothing at path, so
    tables that are read while they are replaced are published by publish_version()."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target, old = jvm.Path(path), jvm.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not replace {path}")
    if not fs.rename(jvm.Path(temp), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(old, True)


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Writes beside the target and renames when whole, so no reader sees half a table; see replace()."""
    temp = f"{path}.building-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(temp)
    replace(df.sparkSession, temp, path)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: it is written beside and renamed over, in one step where the file system has one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(jvm.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    temp = jvm.Path(f"{path}.{uuid.uuid4().hex}")
    out = temp.getFileSystem(spark._jsc.hadoopConfiguration()).create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark._sc._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context.rename(temp, jvm.Path(path), overwrite)


def publish_version(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Writes df as a new version under root, then points readers to it; returns its name. Readers of read_version() see
    the old table or the new one at any moment; old versions stay until they are deleted."""
    name = f"version-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{name}")
    write_pointer(df.sparkSession, f"{root}/CURRENT", name)
    return name


def read_version(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    name = spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0].strip()
    return spark.read.format(fmt).load(f"{root}/{name}")


def append_feedback(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Appends (request_id, helpful, comment) rows with an id and the time; ids of 1 to 100 characters, comments of up to 4000."""
    bad = (F.length("request_id").between(1, 100) & F.col("helpful").isNotNull() & (F.coalesce(F.length("comment"), F.lit(0)) <= 4000)) == False  # noqa: E712
    checked = rows.withColumn("request_id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("bad feedback row")).cast("string")).otherwise(F.col("request_id")))
    out = checked.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp())
    out.write.mode("append").parquet(path)
    return out


def write_versioned(df: DataFrame, root: str, version: str) -> None:
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
