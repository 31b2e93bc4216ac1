"""Pages of files as an extractor returns them: stored raw pages with their text items, and the units
derived from them anew. The extractor itself (PDF, Office, OCR) is not part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash, slugify
from ..operators.parser import parse_files
from .files import exists, publish_version, read_version

BOX = "text:string,x:double,y:double,width:double,height:double"
ITEMS = f"array<struct<{BOX},font_name:string,font_size:double,confidence:double,rotation:double,words:array<struct<{BOX}>>>>"
#: A page: its number, size, text, markdown, and its text items with their words' boxes.
PAGE = f"struct<page_num:int,width:double,height:double,text:string,markdown:string,text_item_count:int,text_items:{ITEMS}>"
#: Fixed value.
SLUG_CHARS = 160


def raw_name(file_id: Column) -> Column:
    """The name under which a file's raw pages are stored: readable, of bounded length, and its own."""
    return F.concat(F.substring(slugify(file_id), 1, SLUG_CHARS), F.lit("-"), short_hash(file_id), F.lit(".json"))


def page_row(page_num: Column, text: Column, markdown: Column | None = None, width: Column | None = None, height: Column | None = None, items: Column | None = None) -> Column:
    """A page as a struct of PAGE; missing text is empty, items are kept as they are."""
    none = F.lit(None).cast("double")
    items = F.coalesce(items, F.array()).cast(ITEMS) if items is not None else F.array().cast(ITEMS)
    return F.struct(
        page_num.cast("int").alias("page_num"), (width if width is not None else none).alias("width"), (height if height is not None else none).alias("height"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(markdown, F.lit("")).alias("markdown") if markdown is not None else F.lit("").alias("markdown"), F.size(items).alias("text_item_count"), items.alias("text_items"),
    ).cast(PAGE)


def write_raw(pages: DataFrame, path: str) -> None:
    """pages: file_id and page (of PAGE). One JSON line a page with the file's raw name, those of a file together."""
    named = pages.select("file_id", "page", raw_name(F.col("file_id")).alias("raw_name"))
    named.repartition("raw_name").sortWithinPartitions("raw_name", "page.page_num").write.mode("errorifexists").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"file_id string, page {PAGE}, raw_name string").json(path)


def rebuild_units(spark: SparkSession, raw_path: str, root: str, excluded: DataFrame | None = None, only: DataFrame | None = None, outline: bool = False) -> DataFrame:
    """Derives the units of all files from their stored raw pages and publishes them as a new version under root; returns
    the rows published. Files in excluded (file_id; those that need OCR) are left out. only (file_id): these files' units
    replace theirs in the version that is there, the others' stay; a file of only that is excluded or has no raw pages
    fails the job, and nothing is published."""
    pages = read_raw(spark, raw_path).select("file_id", F.col("page.page_num").alias("page_num"), F.col("page.text").alias("text"))
    if excluded is not None:
        pages = pages.join(excluded.select("file_id").distinct(), "file_id", "left_anti")
    kept = None
    if only is not None:
        only = only.select("file_id").distinct()
        if missing := only.join(pages.select("file_id").distinct(), "file_id", "left_anti").limit(20).collect():
            raise ValueError(f"no raw pages to rebuild from: {sorted(r[0] for r in missing)}")
        pages = pages.join(only, "file_id", "left_semi")
        if exists(spark, f"{root}/CURRENT"):
            kept = read_version(spark, root).join(only, "file_id", "left_anti")
    units = parse_files(pages, outline)
    publish_version(units if kept is None else kept.unionByName(units), root)
    return read_version(spark, root)
