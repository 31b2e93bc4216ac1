"""Substring dedup (6): words in passages that an earlier document has go.

1. Phrases. Of the 12-word phrases in each window of 50 words, the one with the least hash stands for the window; equal
   windows choose equal phrases, so a passage that recurs brings recurring phrases, and a document offers one phrase in
   about 20 words. Phrases offered by two documents are confirmed as recurring, by hash and then by their words.
2. Automata. Documents are dealt to shards of about SHARD_BYTES of the input's files, and each shard gets the recurring phrases its documents
   offer. It compiles them into Aho-Corasick automata of bounded size and streams all its documents through each, which
   gives every occurrence of every phrase, and with it the windows that can recur.
3. Windows. Candidate windows meet by a 128-bit hash of their words; the smallest document id of each is known from
   then on, and a window whose words also start in a smaller document is covered. Covered words are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, row_splits, sliced, split_bytes, table

WINDOW, PHRASE = 50, 12
#: Characters of phrases that one automaton may hold; about a hundred bytes of memory each.
AUTOMATON_CHARS = 600_000
#: Bytes of the input's files that a shard's texts come from, about.
SHARD_BYTES = 1 << 22
#: Windows with over one in HOT_SHARE of all occurrences, of which there are fewer than that, meet their owner in HOT_PARTS parts.
HOT_SHARE, HOT_PARTS = 200, 64
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def phrase_hashes(w: list[bytes], size: int = PHRASE) -> np.ndarray:
    """A hash of every run of `size` words: a polynomial in the words' hashes, mixed."""
    n = len(w)
    if n < size:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
    powers, back = np.full(n, BASE), np.full(n, INVERSE)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
    p = (total[size:] - total[:-size]) * back[: n - size + 1]
    p ^= p >> np.uint64(31)
    p *= np.uint64(0xBF58476D1CE4E5B9)
    return p ^ (p >> np.uint64(29))


def offered(p: np.ndarray, window: int = WINDOW, size: int = PHRASE) -> np.ndarray:
    """The distinct least phrase hashes of all windows, given all phrase hashes."""
    need = window - size + 1
    if len(p) < need:
        return p[:0]
    m, width = p, 1
    while width * 2 <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < need:
        m = np.minimum(m[: len(p) - need + 1], m[need - width : need - width + len(p) - need + 1])
    return np.unique(m)


class Split:
    """The words of each text, split anew whenever they are gone through: only one text's words are held at a time."""

    def __init__(self, texts: Iterable[bytes]):
        self.texts = texts

    def __iter__(self) -> Iterator[list[bytes]]:
        return (t.split() for t in self.texts)


def locate(texts: Iterable[list[bytes]], wanted: set[int], size: int = PHRASE, most: int = AUTOMATON_CHARS) -> list[np.ndarray]:
    """Starts of every occurrence of the wanted phrases (by hash) in each text, found by automata of their words. The
    texts are gone through several times."""
    phrases: set[str] = set()
    keys = np.array(sorted(wanted), np.uint64)
    held = []  # whether a text has a phrase at all
    for w in texts:
        p = phrase_hashes(w, size)
        _, at = np.unique(p, return_index=True)
        at = at[np.isin(p[at], keys, assume_unique=True)]
        phrases.update([" " + b" ".join(w[i : i + size]).decode("latin-1") + " " for i in at.tolist()])
        held.append(len(at) > 0)
    ends: list[list[np.ndarray]] = [[] for _ in held]
    left = sorted(phrases)
    del phrases
    while left:
        automaton, chars = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 0
        while left and chars < most:
            chars += len(left[-1])
            automaton.add_word(left.pop())
        automaton.make_automaton()
        for w, some, found in zip(texts, held, ends, strict=True):
            if some:
                found.append(np.fromiter((e for e, _ in automaton.iter(" " + b" ".join(w).decode("latin-1") + " ")), np.int64))
        del automaton
    first = []
    for w, e in zip(texts, ends, strict=True):
        if e:  # a match ends on the space after its last word; that of word i is at the i-th of these places
            spaces = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            first.append(np.unique(np.searchsorted(spaces, np.concatenate(e))) - size + 1)
        else:
            first.append(np.zeros(0, np.int64))
    return first


def candidate_windows(n: int, phrases: np.ndarray, window: int = WINDOW, size: int = PHRASE) -> np.ndarray:
    """Starts of the windows that hold one of the phrases that start at `phrases`."""
    count = n - window + 1
    if count <= 0 or not len(phrases):
        return np.zeros(0, np.int64)
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, np.maximum(phrases - (window - size), 0).clip(max=count), 1)
    np.add.at(change, np.minimum(phrases, count - 1) + 1, -1)
    return np.nonzero(np.cumsum(change[:-1]) > 0)[0]


def window_hashes(w: list[bytes], starts: np.ndarray, window: int = WINDOW) -> bytes:
    """16 bytes for each window, of its words joined by a space."""
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_128_digest
    return b"".join([digest(joined[a:b]) for a, b in zip(begins[starts].tolist(), ends[starts + window - 1].tolist(), strict=True)])


def removed_mask(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def cut_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each with the white space before it; what is left keeps its white space."""
    out, at = [], 0
    for word, drop in zip(text.split(), gone.tolist(), strict=True):
        start = text.index(word, at)
        if drop:
            at = start + len(word)
        else:
            out.append(text[at : start + len(word)])
            at = start + len(word)
    return b"".join(out).lstrip() if len(gone) and gone[0] else b"".join(out) + text[at:]


def kept_digest(w: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(w)).hexdigest()


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = True, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, carried columns, n_words, n_removed, kept_sha256, text) of every row.

    Ids are compared as integers; rows of one id never remove each other's words, and rows with a null id neither
    remove nor lose any. Null and empty texts have no words. Without with_text, text is null.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must fit in a window")
    if clash := set(carry) & {"id", "n_words", "n_removed", "kept_sha256", "text"}:
        raise ValueError(f"carried columns would clash with results: {sorted(clash)}")
    shards = row_splits(df) * max(2, -(-split_bytes(df.sparkSession) // SHARD_BYTES))
    extra = [c for c in carry]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"), text.alias("_t"), F.pmod(F.xxhash64(id_col, F.octet_length(text)), F.lit(shards)).cast("int").alias("_shard"),
        F.unhex(F.md5(text)).alias("_digest"), F.struct(*extra, F.lit(0).alias("_")).alias("_rest"),
    )
    firsts = rows.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    copies = rows.select("_id", "_shard", "_digest").join(firsts, "_digest").where("_id > _first").select("_shard", "_id", "_digest").distinct()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            shard, hashes, texts = [], [], []
            for i, t, s in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if i is not None and t:
                    h = offered(phrase_hashes(t.split(), phrase), window, phrase)
                    hashes.append(h.view(np.int64))
                    shard.append(np.full(len(h), s, np.int32))
                    texts.append(np.full(len(h), np.uint64(xxhash.xxh64_intdigest(t))).view(np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shard, hashes, texts)], names=["shard", "h", "text"])

    offers = materialize(rows.select("_id", "_t", "_shard").mapInArrow(offer, "shard int, h long, text long"), "offers")
    recurring = offers.groupBy("h").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo < hi").select("h")
    wanted = offers.select("shard", "h").distinct().join(recurring, "h").select(F.col("shard").alias("_shard"), "h", F.lit(None).cast("long").alias("_id"), F.lit(None).cast("binary").alias("_digest"))
    # what a shard is told: its recurring phrases, and which of its texts are copies
    told = wanted.union(copies.select("_shard", F.lit(None).cast("long").alias("h"), "_id", "_digest"))

    def stream(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        marks = told[told["_digest"].notna()]
        whole = set(zip(marks["_id"].astype(int), map(bytes, marks["_digest"]), strict=True))
        copy = [(None if pd.isna(i) else int(i), bytes(d)) in whole for i, d in zip(docs["_id"], docs["_digest"], strict=True)]
        phrases = told["h"].dropna().astype("int64").to_numpy().view(np.uint64)
        found = locate(Split([b"" if c else t for c, t in zip(copy, docs["_t"], strict=True)]), set(phrases.tolist()), phrase)
        give_back()
        lengths, starts, gone, sha = [], [], [], []
        for w, at, c in zip(Split(docs["_t"]), found, copy, strict=True):
            lengths.append(len(w))
            starts.append(candidate_windows(len(w), at, window, phrase))
            gone.append(len(w) if c and len(w) >= window else 0)
            sha.append(kept_digest([] if gone[-1] else w))
        return pd.DataFrame({
            "id": docs["_id"].astype("Int64"), "rest": docs["_rest"], "n_words": lengths, "n_removed": gone, "kept_sha256": sha,
            "text": [(b"" if n else t) if with_text or len(s) else None for t, s, n in zip(docs["_t"], starts, gone, strict=True)],
            "starts": [s.astype("<i4").tobytes() if len(s) else None for s in starts],
        })

    rest = rows.schema["_rest"].dataType.simpleString()
    schema = f"id long, rest {rest}, n_words long, n_removed long, kept_sha256 string, text binary, starts binary"
    # phrases and marks are told as h: a long with nulls would come as a double, so it goes as a string
    told = told.withColumn("h", F.col("h").cast("string"))
    streamed = rows.groupBy("_shard").cogroup(told.groupBy("_shard")).applyInPandas(stream, schema)
    located = materialize(streamed.select(F.monotonically_increasing_id().alias("uid"), "*"), "located")
    discard(offers)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for uid, i, s, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                s = np.frombuffer(s, "<i4")
                h = np.frombuffer(window_hashes(t.split(), s, window), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), uid, np.int64)), pa.array(np.full(len(s), i, np.int64)), pa.array(s), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=["uid", "id", "start", "h1", "h2"])

    hits = located.where("starts IS NOT NULL AND id IS NOT NULL")
    windows = hits.select("uid", "id", "starts", "text").mapInArrow(flat, "uid long, id long, start int, h1 long, h2 long")
    owners = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    owners = materialize(owners.select("h1", "h2", "lo", "n"), "owners")
    # a window that very many documents have is dealt out: it is known to all tasks (there are few such), and its owner goes to each part
    hot = F.col("n") > (owners.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    spread = owners.select("h1", "h2", "lo", F.explode(parts).alias("part"))
    marked = windows.join(F.broadcast(owners.where(hot).select("h1", "h2", F.lit(True).alias("hot"))), ["h1", "h2"], "left")
    marked = marked.withColumn("part", F.when(F.col("hot"), F.pmod("uid", F.lit(HOT_PARTS)).cast("int")).otherwise(0))
    covered = marked.join(spread, ["h1", "h2", "part"]).where("id > lo").groupBy("uid").agg(F.collect_list("start").alias("covered"))  # of one document
    out = f"id long, rest {rest}, n_words long, n_removed long, kept_sha256 string, text binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            removed, sha, texts = [], [], []
            for n, t, s in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                gone = removed_mask(n, np.array(s, np.int64), window)
                w = [x for x, drop in zip(t.split(), gone.tolist(), strict=True) if not drop]
                removed.append(int(gone.sum()))
                sha.append(kept_digest(w))
                texts.append(cut_words(t, gone) if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary())], names=["id", "rest", "n_words", "n_removed", "kept_sha256", "text"])

    # texts without candidates are done; only the others meet what is covered in them
    none = F.array().cast("array<int>")
    cut = hits.join(covered, "uid", "left").select("id", "rest", "n_words", "text", F.coalesce("covered", none).alias("covered")).mapInArrow(remove, out)
    same = located.where("starts IS NULL OR id IS NULL").select("id", "rest", "n_words", "n_removed", "kept_sha256", F.col("text") if with_text else F.lit(None).cast("binary").alias("text"))
    return same.union(cut).select("id", *[F.col("rest")[c].alias(c) for c in extra], "n_words", "n_removed", "kept_sha256", F.col("text").cast("string").alias("text"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe(table(spark, sf_dir, "documents"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, j, array_to_string(w[j : j + 49], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM d WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS lo FROM x GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(j, j + 50)) AS i FROM x JOIN m USING (k) WHERE doc_id > lo),
n AS (SELECT r, count(*) AS gone FROM g GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) t ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
