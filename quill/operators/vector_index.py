"""Approximate vector search by dot product: coarse cells, product-quantised codes of what cells leave over, exact re-ranking.

fit() learns centres from a bounded sample; build() gives every row a cell and a code of one byte a part, a sixteenth of
the vector or less; search() reads codes of the cells nearest a question (or all), keeps the best by their estimated product,
and reads whole vectors for these alone, so what is returned has exact scores and is ordered by them. recall() says how many
of the exact best were found."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import top

#: Rows of the sample that centres are fitted on; of a table with more, those with the least hashes of their ids.
SAMPLE_ROWS = 16_384
#: Questions of one pass; more are searched in blocks. A task holds that many lists of its best estimates.
BLOCK = 1_000
#: Up to so many pairs of a question and a row are broadcast to the whole vectors; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000


@dataclass(frozen=True)
class Codebook:
    cells: np.ndarray  # cell, dimension
    parts: np.ndarray  # part, code, dimension of a part

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts (the last padded with zeros): part, row, dimension of a part."""
        n, width = len(self.parts), self.parts.shape[2]
        return np.pad(x, ((0, 0), (0, n * width - x.shape[1]))).reshape(len(x), n, width).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.cells)
        return cell, np.stack([nearest(p, c) for p, c in zip(self.split(x - self.cells[cell]), self.parts, strict=True)], 1).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def centres_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from k rows at even steps; a centre without rows stays where it is."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, out)
        n = np.bincount(at, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, at, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def usable(vector: str, dimension: int) -> Column:
    """Vectors of this length without nulls and numbers that aren't finite; others have no code and are never found."""
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & fine, F.lit(False))


def fit(vectors: DataFrame, dimension: int, cells: int = 64, parts: int = 16, key: str = "vec_id", vector: str = "embedding") -> Codebook:
    """Centres from at most SAMPLE_ROWS rows, which come to the driver (8 bytes a number). The same rows give the same centres."""
    drawn = vectors.where(usable(vector, dimension)).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not drawn:
        raise ValueError("there are no vectors to fit centres on")
    x = np.array([r["v"] for r in drawn])
    coarse = centres_of(x, cells)
    width = -(-dimension // parts)
    book = Codebook(coarse, np.zeros((parts, 1, width)))
    pieces = book.split(x - coarse[nearest(x, coarse)])
    return Codebook(coarse, np.stack([centres_of(p, 256) for p in pieces]))


def build(vectors: DataFrame, book: Codebook, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cell, code) of every usable row, in the order of cells when written by write_codes()."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)  # centres alone: their number is fixed
    rows = vectors.where(usable(vector, book.cells.shape[1])).select(key, F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, code = shared.value.encode(np.stack(pdf["v"].to_numpy()))
                yield pd.DataFrame({key: pdf[key], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    return rows.mapInPandas(run, f"`{key}` {dict(vectors.dtypes)[key]}, cell int, code binary")


def write_codes(codes: DataFrame, path: str, key: str = "vec_id") -> DataFrame:
    """Codes in ranges of (cell, key), so that a cell's rows lie together and a large cell lies in several files."""
    codes.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.parquet(path)
    return codes.sparkSession.read.parquet(path)


def search(codes: DataFrame, vectors: DataFrame, book: Codebook, questions: DataFrame, limit: int, probes: int | None = None, rerank: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """questions: query_id, query_vector. (query_id, key, score, rank) of the best `limit` of each by exact product, ties by
    key, among the `rerank` (20 times limit) rows of the largest estimates in the `probes` nearest cells (all)."""
    rerank = rerank or 20 * limit
    asked = questions.where(usable("query_vector", book.cells.shape[1])).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    rows = asked.limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        raise ValueError(f"over {BLOCK} questions: give them in blocks")
    if not rows:
        return vectors.limit(0).select(F.lit(None).cast(dict(questions.dtypes)["query_id"]).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    ids, q = [r["query_id"] for r in rows], np.array([r["query_vector"] for r in rows])
    by_cell = q @ book.cells.T
    allowed = np.ones_like(by_cell, bool)
    if probes and probes < len(book.cells):
        allowed = np.zeros_like(allowed)
        np.put_along_axis(allowed, np.argsort(-by_cell, axis=1, kind="stable")[:, :probes], True, axis=1)
        codes = codes.where(F.col("cell").isin([int(c) for c in np.flatnonzero(allowed.any(0))]))
    tables = np.einsum("pqd,pcd->pqc", book.split(q), book.parts)  # product of a question's part and a code's
    shared = vectors.sparkSession.sparkContext.broadcast((ids, by_cell, allowed, tables))
    id_type, key_type = dict(questions.dtypes)["query_id"], dict(vectors.dtypes)[key]

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, by_cell, allowed, tables = shared.value
        best = [(np.empty(0), np.empty(0, object)) for _ in ids]
        for pdf in batches:
            cell, keys = pdf["cell"].to_numpy(), pdf[key].to_numpy()
            code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
            for k in range(len(ids)):
                here = np.flatnonzero(allowed[k][cell])
                got = by_cell[k][cell[here]]
                for p in range(code.shape[1]):
                    got += tables[p, k][code[here, p]]
                score, found = np.concatenate([best[k][0], got]), np.concatenate([best[k][1], keys[here]])
                keep = np.argpartition(-score, rerank)[:rerank] if len(score) > rerank else slice(None)
                best[k] = score[keep], found[keep]
        for k, (score, found) in zip(ids, best, strict=True):
            if len(found):
                yield pd.DataFrame({"query_id": k, key: found, "estimate": score})

    near = top(codes.select(key, "cell", "code").mapInPandas(estimate, f"query_id {id_type}, `{key}` {key_type}, estimate double"), "estimate", rerank, by=("query_id",), tie=(key,)).select("query_id", key)
    pairs = F.broadcast(near) if len(rows) * rerank <= BROADCAST_PAIRS else near
    whole = vectors.select(key, vector).join(pairs, key).join(F.broadcast(asked), "query_id")  # at most BLOCK questions
    dot = F.aggregate(F.zip_with(vector, "query_vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return top(whole.select("query_id", key, dot.alias("score")), "score", limit, by=("query_id",), tie=(key,))


def search_blocks(path: str, codes: DataFrame, vectors: DataFrame, book: Codebook, questions: DataFrame, limit: int, probes: int | None = None, rerank: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """search() of any number of questions with different ids: in blocks by a hash of the id, each of which writes its rows
    below path before the next begins, so neither plans nor tasks grow with their number."""
    blocks = max(1, -(-questions.count() // (BLOCK // 2)))
    for b in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        search(codes, vectors, book, part, limit, probes, rerank, key, vector).write.parquet(f"{path}/block={b}")
    return vectors.sparkSession.read.parquet(*[f"{path}/block={b}" for b in range(blocks)])


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, n_exact, n_found): how many of the exact rows of a question are among those found."""
    hit = found.select("query_id", key, F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", key], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("_hit").alias("n_found"))
