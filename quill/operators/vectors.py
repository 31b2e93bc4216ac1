"""Vectors of units: encoded by a model that the caller gives, stored with what they were made by, scanned and searched.

A store is a version under a root: vectors as parquet, and beside them their dimension, number and settings, against which
a scan checks them and a search its questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import publish_version, read_version
from ..sources.state import read_state, write_state
from .search import vector_top


def encode(units: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "embedding", batch: int = 32, normalize: bool = True) -> DataFrame:
    """units with a vector each; model takes a list of texts to a matrix of as many rows, and runs where the rows lie."""
    schema = ", ".join(f"`{c}` {t}" for c, t in units.dtypes) + f", `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[np.ndarray] = []
            for at in range(0, len(pdf), batch):
                texts = pdf[text].iloc[at : at + batch].fillna("").tolist()
                got = np.asarray(model(texts), np.float64)
                if got.ndim != 2 or len(got) != len(texts):
                    raise ValueError(f"the model gave a shape of {got.shape} for {len(texts)} texts")
                if normalize:
                    got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                rows += list(got.astype(np.float32))
            yield pdf.assign(**{out: rows})

    return units.mapInPandas(run, schema)


def write_vectors(vectors: DataFrame, root: str, settings: Mapping, vector: str = "embedding") -> dict:
    """Publishes vectors with their columns; returns what is stored beside them. Vectors of several lengths are refused."""
    spark = vectors.sparkSession
    publish_version(vectors, root)
    facts = read_version(spark, root).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count_if(F.col(vector).isNull()).alias("nulls")).first()
    if facts["nulls"] or facts["lo"] != facts["hi"]:
        raise ValueError("vectors are missing or differ in length")
    state = {"rows": facts["n"], "dimension": facts["lo"], "settings": dict(settings)}
    write_state(spark, f"{root}/STATE", state)
    return state


def read_vectors(spark: SparkSession, root: str, settings: Mapping | None = None) -> DataFrame:
    """The stored rows. With settings, those they were made by must be the same."""
    state = read_state(spark, f"{root}/STATE")
    if not state:
        raise FileNotFoundError(f"no vectors under {root}")
    if settings is not None and state["settings"] != dict(settings):
        raise ValueError("the vectors were made by other settings: build them anew")
    rows = read_version(spark, root)
    if rows.count() != state["rows"]:
        raise ValueError("there are not as many vectors as were stored")
    return rows


def search(spark: SparkSession, root: str, questions: DataFrame, limit: int, filters: Mapping[str, str] | None = None, key: str = "vec_id", vector: str = "embedding", settings: Mapping | None = None) -> DataFrame:
    """questions: query_id, query_vector. The best `limit` stored rows of each, among those with these columns' values."""
    rows = read_vectors(spark, root, settings)
    dimension = read_state(spark, f"{root}/STATE")["dimension"]
    if questions.where(F.size("query_vector") != dimension).limit(1).count():
        raise ValueError(f"questions need vectors of {dimension} numbers")
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == value)
    return vector_top(rows, questions, limit, key, vector)
