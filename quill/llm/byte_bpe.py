"""Byte-level BPE encoding and decoding (7) by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from its own first character, which may
lie inside a pre-token. As the pattern never looks behind, two runs that share one boundary agree from there on; so the
chunks are stitched at the first boundary both have in their overlap, and a chunk's own last matches, which could have
gone on past its end, never count. If no boundary is shared (a pre-token longer than the overlap), the text from the
last sure boundary through the next chunk is pre-tokenised anew. The pieces are then encoded one by one, with a bounded
cache, and ids decode to the concatenation of their tokens' raw bytes.

Texts of several chunks are dealt out chunk by chunk, so a very long text does not hold up one task's pre-tokenising.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK, OVERLAP, CACHE = 1 << 15, 1 << 10, 300_000


class ByteBpe:
    """A vocabulary of ranks with its pre-token pattern, and a cache of at most CACHE encoded pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {i: b for b, i in ranks.items()}
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        return self.bpe._core_bpe.encode_single_piece(piece.encode())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def digest(self, pieces: list[str]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by a space, SHA-256 of the bytes they decode to."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for p in set(pieces).difference(cache):
            ids = self.encode_piece(p)
            cache[p] = len(ids), b" ".join([b"%d" % i for i in ids]), self.decode(ids)
        got = [cache[p] for p in pieces]
        return sum([g[0] for g in got]), hashlib.sha256(b" ".join([g[1] for g in got])).hexdigest(), hashlib.sha256(b"".join([g[2] for g in got])).hexdigest()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, characters) of overlapping chunks; one chunk for a text that fits."""
    if len(text) <= chunk + overlap:
        return [(0, text)]
    return [(s, text[s : s + chunk + overlap]) for s in range(0, len(text), chunk) if s == 0 or s + overlap < len(text)]


def boundaries(pattern: regex.Pattern, chunk: str, start: int) -> np.ndarray:
    """Where the pre-tokens of a chunk begin, in the text's characters, and the end of the last one."""
    lengths = [len(p) for p in pattern.findall(chunk)]
    return start + np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])


def stitch(text: str, starts: list[int], bounds: list[np.ndarray], pattern: regex.Pattern, reach: int) -> list[str]:
    """Pre-tokens of the whole text from those of its chunks. reach: length of a full chunk."""
    have = [bounds[0]]
    for k in range(1, len(starts)):
        left = have[-1]
        # the last two matches touch the chunk's end or depend on what follows it
        sure = left[:-2] if len(left) > 2 else left[:1]
        right = bounds[k]
        shared = np.intersect1d(sure[sure >= starts[k]], right[:-2] if k + 1 < len(starts) else right, assume_unique=True)
        if len(shared):
            p = shared[0]
            have[-1] = left[left <= p][:-1]
            have.append(right[right >= p])
        else:
            p = int(sure[-1])
            have[-1] = sure[:-1]
            have.append(boundaries(pattern, text[p : starts[k] + reach], p))
    at = np.concatenate(have).tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def pretokens(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    parts = cut(text, chunk, overlap)
    if len(parts) == 1:
        return pattern.findall(text)
    return stitch(text, [s for s, _ in parts], [boundaries(pattern, c, s) for s, c in parts], pattern, chunk + overlap)


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, whatever its id; null and empty texts have no ids.

    Short texts are encoded where they are read. Only texts of several chunks are shuffled, by chunk and then by text.
    """
    out = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            got = [bpe.digest(bpe.pattern.findall(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=names)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, i, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                parts = cut(t)
                yield pa.RecordBatch.from_pydict({"uid": [uid] * len(parts), "id": pa.array([i] * len(parts), pa.int64()), "start": [s for s, _ in parts], "chunk": [c for _, c in parts]})

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            at = [boundaries(bpe.pattern, c, s).astype("<i8").tobytes() for s, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.binary())], names=["uid", "id", "start", "chunk", "at"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path, pattern)
        pdf = pdf.sort_values("start")
        starts = pdf["start"].tolist()
        chunks = pdf["chunk"].tolist()
        text = "".join([c[: b - a] for c, a, b in zip(chunks, starts, starts[1:], strict=False)]) + chunks[-1]
        pieces = stitch(text, starts, [np.frombuffer(x, "<i8") for x in pdf["at"]], bpe.pattern, CHUNK + OVERLAP)
        return pd.DataFrame([(pdf["id"].iloc[0], *bpe.digest(pieces))], columns=names).astype({"id": "Int64"})

    fits = F.length("t") <= CHUNK + OVERLAP
    long = rows.where(~fits).select(F.monotonically_increasing_id().alias("uid"), "id", "t")
    parts = long.mapInArrow(chunked, "uid long, id long, start long, chunk string").repartition(F.col("uid"), F.col("start"))
    pieces = parts.mapInArrow(cut_up, "uid long, id long, start long, chunk string, at binary")
    return rows.where(fits).mapInArrow(short, out).union(pieces.groupBy("uid").applyInPandas(whole, out))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
