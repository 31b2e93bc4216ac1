"""A corpus pipeline: quality, near-duplicates, repeated passages, test items, token ids.

run() writes each stage's rows to the shared folder that the cluster names and rereads them as the next stage's input,
so a stage's work is done once, whatever becomes of its executors later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.byte_bpe import encode_digests
from quill.llm.common import materialize
from quill.llm.decontamination import contaminated
from quill.llm.quality import score, train
from quill.llm.simhash import representatives, text_key
from quill.llm.substrings import dedupe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.3 go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(COLUMNS), model).where("score >= 0.3").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.
    A row without an id, or with an id that another text has as well, goes only if its own text has a copy that stays."""
    kept = representatives(docs)
    keyed = docs.select(*COLUMNS, text_key(F.col("text")).alias("_node"))
    return keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["id"]) & (keyed["_node"] == kept["node"]), "left_semi").dropDuplicates(["doc_id", "_node"]).select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that an earlier document has are cut; a document that loses all its words goes."""
    cut = dedupe(docs, carry=("lang", "source")).where("n_removed = 0 OR n_removed < n_words")
    return cut.select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go, by their texts: whatever ids they have, or none."""
    keyed = docs.select(*COLUMNS, text_key(F.col("text")).alias("_node"))
    found = contaminated(keyed.select("_node", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_node").select(F.col("id").alias("_node")).distinct()
    return keyed.join(found, "_node", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("substring dedup", repeats), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]
#: The classifier's fit, the hashes' links and the encoding are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
