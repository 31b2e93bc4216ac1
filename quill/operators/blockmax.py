"""Packed postings in blocks that know their largest impact, and top-k search that reads few of them.

Documents are dealt to shards by a hash, SHARD_DOCS or so in each, so that a common term's postings are spread. Within a
shard, a term's postings lie by document in blocks of BLOCK: the first and last document, the largest impact (the part of
BM25 that depends on the document alone), and the documents' gaps, frequencies and lengths as bytes of seven bits each.

A search takes its documents from its rarest terms, as bm25() does, and knows for each of them, without unpacking anything
else, the most it could score: what the rarest terms give it and the peaks of the other terms' blocks it would lie in.
Documents are scored from the highest bound down, a block being unpacked when the first document in it is scored, until no
bound reaches the score of the last place. The rows are those of bm25() with min_match and limit; block_use() counts blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import BM25_B, BM25_K1
from .index import Index
from .search import candidates, held, search_terms, top

BLOCK, SHARD_DOCS = 128, 1 << 14
#: Searches that one task runs over a shard.
SEARCHES = 1000
#: Documents that are scored at once, at least.
CHUNK = 64
PACKED = "shard int, term string, n int, first long, last long, peak double, packed binary"


def seven_bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, the lowest first, the high bit on all but the last."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= 1 << 7 * k
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    within = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * within, starts)


def impact(tf: np.ndarray, doc_len: np.ndarray, avg_len: float) -> np.ndarray:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * np.maximum(doc_len, 1) / avg_len))


def shards(index: Index, docs: int = SHARD_DOCS) -> int:
    return max(1, -(-index.stats.first()["n_docs"] // docs))


def pack(index: Index, block: int = BLOCK, docs: int = SHARD_DOCS) -> DataFrame:
    """PACKED rows of all postings. doc_id is a long. Peaks are by the index's mean length, so an index that grows is packed
    anew. To be written sorted as it is: a search's terms are pushed to its scan."""
    count, avg_len = shards(index, docs), index.stats.first()["avg_len"] or 1.0
    rows = index.postings.join(index.docs.select("doc_id", "doc_len"), "doc_id")
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("shard"), "term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            out, rest = cut(t, False)
            if out is not None:
                yield out
        if rest is not None and len(rest):
            yield cut(rest, True)[0]

    def cut(t: pa.Table, end: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        """Blocks of t; the last one is kept for what follows it unless this is the end."""
        t = t.combine_chunks()
        shard, doc, tf, size = (t[c].to_numpy() for c in ("shard", "doc_id", "tf", "doc_len"))
        term = t["term"].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (term[1:] != term[:-1])))
        within = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
        at = np.flatnonzero(within % block == 0)
        done = len(t) if end else int(at[-1])
        if not end:
            at = at[:-1]
        if not len(at):
            return None, t
        doc, tf, size = doc[:done], tf[:done], size[:done]
        gaps = np.diff(doc, prepend=doc[0])
        gaps[at] = 0
        raw, lengths = seven_bits(np.stack([gaps, tf, size], 1).ravel())
        ends = np.cumsum(lengths)[2::3]  # of postings
        last = np.append(at[1:], done) - 1
        offsets = np.append(0, ends[last]).astype("<i4")
        packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
        out = [pa.array(shard[at], pa.int32()), pa.array(term[at], pa.string()), pa.array(last - at + 1, pa.int32()), pa.array(doc[at]), pa.array(doc[last]), pa.array(np.maximum.reduceat(impact(tf, size, avg_len), at)), packed]
        return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in PACKED.split(", ")]), t.slice(done)

    return rows.repartition("shard").sortWithinPartitions("shard", "term", "doc_id").mapInArrow(blocks, PACKED).sortWithinPartitions("term", "first")


class TermBlocks:
    """The blocks of one term in a shard."""

    def __init__(self, rows: pd.DataFrame, avg_len: float):
        rows = rows.sort_values("first")
        self.first, self.last, self.peak, self.n = (rows[c].to_numpy() for c in ("first", "last", "peak", "n"))
        self.packed, self.avg_len = rows["packed"].tolist(), avg_len

    def find(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, whether there is one) in which each document would lie."""
        at = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        return at, (self.first[at] <= docs) & (docs <= self.last[at])

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of these blocks, in ascending order of both."""
        gaps, tf, size = unpacked(b"".join([self.packed[i] for i in blocks.tolist()])).reshape(-1, 3).T
        n = self.n[blocks]
        total = np.cumsum(gaps)
        starts = np.cumsum(n) - n
        return total - np.repeat(total[starts] - self.first[blocks], n), impact(tf, size, self.avg_len)


def best(terms: list[tuple[float, bool, TermBlocks]], least: int, limit: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents, scores, blocks of all terms, blocks unpacked) of one search in one shard. terms: weight, whether it is one
    of the rarest, blocks."""
    every = sum(len(b.n) for _, _, b in terms)
    rare, others = [x for x in terms if x[1]], [x for x in terms if not x[1]]
    if not rare:
        return np.zeros(0, np.int64), np.zeros(0), every, 0
    read = [b.read(np.arange(len(b.n))) for _, _, b in rare]
    docs, of = np.unique(np.concatenate([d for d, _ in read]), return_inverse=True)
    known = np.bincount(of, np.concatenate([w * i for (w, _, _), (_, i) in zip(rare, read, strict=True)]), len(docs))
    enough = np.bincount(of, minlength=len(docs)) >= least
    docs, known = docs[enough], known[enough]
    places = [b.find(docs) for _, _, b in others]
    bound = known + sum((np.where(there, w * b.peak[at], 0.0) for (w, _, b), (at, there) in zip(others, places, strict=True)), np.zeros(len(docs)))
    order, used = np.argsort(-bound, kind="stable"), [np.zeros(len(b.n), bool) for _, _, b in others]
    score, done, floor = known.copy(), 0, -np.inf
    while done < len(docs) and bound[order[done]] >= floor - 1e-5:  # scores are compared rounded
        some = np.sort(order[done : done + max(limit, CHUNK)])
        for (w, _, b), (at, there), seen in zip(others, places, used, strict=True):
            inside = some[there[some]]
            if len(inside):
                blocks = np.unique(at[inside])
                seen[blocks] = True
                held_, impacts = b.read(blocks)
                place = np.minimum(np.searchsorted(held_, docs[inside]), len(held_) - 1)
                score[inside] += np.where(held_[place] == docs[inside], w * impacts[place], 0.0)
        done += len(some)
        if done >= limit:
            floor = np.partition(score[order[:done]], -limit)[-limit]
    scored = order[:done]
    first = scored[np.lexsort((docs[scored], -np.round(score[scored], 6)))[:limit]]
    return docs[first], score[first], every, sum(len(b.n) for _, _, b in rare) + sum(int(u.sum()) for u in used)


def _run(blocks: DataFrame, index: Index, searches: DataFrame, limit: int, stopwords: Sequence[str], min_match: bool, docs: int) -> DataFrame:
    """(search_id, doc_id, bm25, blocks, used): the first places by shard, and a row without a document for its blocks."""
    asked, few = held(search_terms(searches, stopwords))
    names = sorted({r["term"] for r in asked.select("term").collect()}) if few else None
    stats = index.stats.first()
    count, avg_len = shards(index, docs), stats["avg_len"] or 1.0
    batches = max(1, -(-searches.count() // SEARCHES))
    weight = scoring.idf(F.lit(stats["n_docs"]), F.col("df")) * F.col("qf")
    terms = candidates(asked, index, names=names).where("df IS NOT NULL")
    terms = terms.select("search_id", "term", weight.alias("weight"), "is_candidate", "min_match", F.pmod(F.xxhash64("search_id"), F.lit(batches)).alias("batch"))
    if names is not None and len(names) <= 1000:
        blocks = blocks.where(F.col("term").isin(names))
    wanted = terms.select(F.col("batch").alias("_batch"), "term").distinct()
    found = blocks.join(F.broadcast(wanted) if few else wanted, "term")
    everywhere = terms.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    kind = dict(searches.dtypes)["search_id"]
    least = min_match

    def run(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        by_term = {t: TermBlocks(rows, avg_len) for t, rows in b.groupby("term")}
        out = []
        for search, rows in q.groupby("search_id"):
            mine = [(w, c, by_term[t]) for t, w, c in zip(rows["term"], rows["weight"], rows["is_candidate"], strict=True) if t in by_term]
            ids, scores, every, used = best(mine, int(rows["min_match"].iloc[0]) if least else 1, limit)
            out.append((search, None, None, every, used))
            out += [(search, d, s, None, None) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        got = pd.DataFrame(out, columns=["search_id", "doc_id", "bm25", "blocks", "used"])
        return got.astype({"doc_id": "Int64", "blocks": "Int64", "used": "Int64"})

    pairs = found.groupBy("shard", "_batch").cogroup(everywhere.groupBy("shard", "batch"))
    return pairs.applyInPandas(run, f"search_id {kind}, doc_id long, bm25 double, blocks long, used long")


def pruned_top(blocks: DataFrame, index: Index, searches: DataFrame, limit: int, stopwords: Sequence[str] = (), min_match: bool = True, docs: int = SHARD_DOCS) -> DataFrame:
    """(search_id, doc_id, bm25, rank) of the first `limit` documents of each search, as bm25() has them. blocks: a stored
    table of pack(index, docs=docs). A search without known terms has no rows; an empty index gives none."""
    rows = _run(blocks, index, searches, limit, stopwords, min_match, docs).where("doc_id IS NOT NULL AND bm25 > 0")
    return top(rows.select("search_id", "doc_id", "bm25"), "bm25", limit)


def block_use(blocks: DataFrame, index: Index, searches: DataFrame, limit: int, stopwords: Sequence[str] = (), min_match: bool = True, docs: int = SHARD_DOCS) -> DataFrame:
    """(search_id, blocks, used): the blocks of a search's terms, and those that it unpacked."""
    rows = _run(blocks, index, searches, limit, stopwords, min_match, docs).where("doc_id IS NULL")
    return rows.groupBy("search_id").agg(F.sum("blocks").alias("blocks"), F.sum("used").alias("used"))
