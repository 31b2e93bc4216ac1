"""Quality classifier (3): a linear-chain conditional random field over the lines of a document.

Every line gets a label, good or bad, from its own features, those of its neighbours and the label of the line before;
the marginals of forward-backward, weighted by the lines' lengths, average to the document's score. Training lines take
their document's label. The model is fitted on the driver over a bounded sample of labelled rows, from line features
(not texts) that the executors compute; scoring reads every line of every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Bounds of the training sample: labelled documents, and pieces of each one's lines, drawn from all of them. Scoring has no bound.
SAMPLE_DOCS, PIECE, PIECES = 4000, 32, 256
OWN, NEAR = 13, 6
WIDTH = OWN + 3 * NEAR + 2

_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """For code points below 2^16, bits: 1 upper case, 2 digit, 4 neither letter, digit nor white space, 8 white space."""
    global _classes
    if _classes is None:
        _classes = np.array([c.isupper() + 2 * c.isdigit() + 4 * (not c.isalnum() and not c.isspace()) + 8 * c.isspace() for c in map(chr, range(1 << 16))], np.uint8)
    return _classes


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features by line, lengths) of the lines that aren't blank."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _class_table()[np.minimum(codes, 0xFFFF)]
    n = np.array([len(x) for x in lines], np.float64)
    starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int64)
    upper, digit, symbol, space = (np.add.reduceat((kind & bit).astype(bool), starts, dtype=np.float64) / n for bit in (1, 2, 4, 8))
    pipes = np.add.reduceat(codes == 124, starts, dtype=np.float64)
    own = np.zeros((len(lines), OWN), np.float64)
    seen: set[str] = set()
    for i, x in enumerate(lines):
        w = x.split()
        kinds = len(set(w))
        own[i, 0] = kinds / len(w)
        own[i, 1] = sum(map(eq, w, w[1:])) / len(w)
        own[i, 2] = np.log1p(len(w))
        own[i, 3] = n[i] / len(w) / 10
        own[i, 4] = x in seen
        own[i, 5] = x.endswith((".", "!", "?"))
        own[i, 12] = np.log1p(len(w)) * kinds / len(w)
        seen.add(x)
    own[:, 6], own[:, 7], own[:, 8], own[:, 9] = upper, digit, symbol, space
    own[:, 10] = pipes / np.maximum(1, np.expm1(own[:, 2]))
    own[:, 11] = np.log1p(n)
    near = own[:, [0, 1, 3, 6, 8, 10]]
    before, after = np.vstack([near[:1], near[:-1]]), np.vstack([near[1:], near[-1:]])
    edge = np.zeros((len(lines), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, before, after, np.abs(before - after), edge]).astype(np.float32), n


@dataclass(frozen=True)
class Crf:
    """States 0 (bad) and 1 (good). weight scores state 1 against 0; step[a, b] scores b after a; prior answers for texts without lines."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray
    prior: float

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        e = np.zeros((len(features), 2))
        e[:, 1] = ((features - self.mean) / self.scale) @ self.weight + self.bias
        _, m, _ = forward_backward(e[None], np.array([len(e)]), self.step)
        return m[0, :, 1]

    def score(self, text: str | None) -> float:
        f, n = line_features(text)
        if not len(f):
            return self.prior
        return float(np.clip(self.marginals(f) @ n / n.sum(), 0, 1))


def forward_backward(e: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition, state marginals, expected transitions) of chains e[chain, line, state], padded beyond lengths."""
    chains, most, _ = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    on = np.arange(most)[None, :] < lengths[:, None]
    alpha[:, 0] = e[:, 0]
    for t in range(1, most):
        new = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + e[:, t]
        alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        nxt = e[:, t + 1] + beta[:, t + 1]
        new = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
        beta[:, t] = np.where(on[:, t + 1, None], new, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    m = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
    moves = np.zeros((2, 2))
    if most > 1:
        pair = alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        moves = (np.exp(pair) * on[:, 1:, None, None]).sum(axis=(0, 1))
    return z, m, moves


def drawn(features: np.ndarray) -> np.ndarray:
    """The lines of PIECES pieces of PIECE lines, in order; all lines of a document that has no more."""
    pieces = -(-len(features) // PIECE)
    if pieces <= PIECES:
        return features
    kept = np.sort(np.argsort([xxhash.xxh64_intdigest(b"%d/%d" % (k, pieces)) for k in range(pieces)], kind="stable")[:PIECES])
    return np.concatenate([features[k * PIECE : (k + 1) * PIECE] for k in kept])


def fit(rows: list[tuple[int, np.ndarray]], steps: int = 250, rate: float = 0.08, decay: float = 2e-3, piece: int = 32) -> Crf:
    """rows: (label, line features). Chains are cut to pieces of `piece` lines. Without rows of either label the score is 0.5."""
    rows = [(y, f[i : i + piece]) for y, f in rows for i in range(0, len(f), piece)]
    if not rows:
        return Crf(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)), 0.5)
    every = np.vstack([f for _, f in rows])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    lengths = np.array([len(f) for _, f in rows])
    x = np.zeros((len(rows), lengths.max(), WIDTH))
    y = np.array([label for label, _ in rows])
    for i, (_, f) in enumerate(rows):
        x[i, : len(f)] = (f - mean) / scale
    on = np.arange(x.shape[1])[None, :] < lengths[:, None]
    theta, first, second = np.zeros(WIDTH + 5), np.zeros(WIDTH + 5), np.zeros(WIDTH + 5)
    same = (lengths - 1)[:, None, None] * np.array([[[1, 0], [0, 0]], [[0, 0], [0, 1]]])[y]
    total = lengths.sum()
    for k in range(1, steps + 1):
        e = np.zeros((*x.shape[:2], 2))
        e[:, :, 1] = x @ theta[:WIDTH] + theta[WIDTH]
        _, m, moves = forward_backward(e, lengths, theta[WIDTH + 1 :].reshape(2, 2))
        miss = (y[:, None] - m[:, :, 1]) * on
        grad = np.concatenate([np.tensordot(miss, x, ([0, 1], [0, 1])), [miss.sum()], (same.sum(0) - moves).ravel()]) / total - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Crf(mean, scale, theta[:WIDTH], float(theta[WIDTH]), theta[WIDTH + 1 :].reshape(2, 2), float(y.mean()))


def fold(id_col: str, n: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> Crf:
    """Fits on at most `sample` labelled documents outside the held-out fold, taken in the order of a hash of their id.
    Rows without id or label don't count; a document labelled twice counts by its lower label, and of rows that repeat an
    id one counts. A document of over PIECES pieces of PIECE lines counts by so many, drawn from the whole of it by a hash."""
    held_in = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, folds) != 0))
    chosen = held_in.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [drawn(line_features(t)[0]).astype("<f4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=["id", "y", "f"])

    rows = docs.join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("long").alias("id"), F.col("_y").alias("y"), F.col(text_col).alias("t"))
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("t").alias("t"))  # rows that repeat an id are one
    got = sorted((r["id"], r["y"], bytes(r["f"])) for r in rows.mapInArrow(run, "id long, y int, f binary").collect())
    return fit([(y, np.frombuffer(f, "<f4").reshape(-1, WIDTH)) for _, y, f in got if f])


def score(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """docs with a column score; a text that is null, empty or blank has the share of good training lines' documents."""
    if "score" in docs.columns:
        raise ValueError("docs has a column score already")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
