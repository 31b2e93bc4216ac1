"""Token-ID / binary output (5).

Rows are range-partitioned and sorted by id (rows of one id by their text's hash and the text); every partition becomes
one shard, a file of three parts:
  payload   the raw ids of all its texts, one after another, little-endian, 2 bytes each (4 for vocabularies over 65536)
  index     a minimal perfect hash index: a JSON head line, then the displacement of each bucket (u4), and by slot the
            key's fingerprint (u4), where its ids start (u8) and how many there are (u4), and at the end the keys (i8) in
            the order of the payload, nulls first, so that a shard can be listed
  tail      where the index begins (u8)
A key is looked up in constant time: its bucket's displacement names the one slot it can have, the fingerprint stored
there tells a key that was never added (but for one in 2^32), and the slot gives the place in the payload.

A file is written under a temporary name and renamed when whole, so index and payload appear together, a repeated task
replaces an equal file, as the order of rows is total, and a lost executor leaves nothing half-written. Paths are URIs of any file system that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_splits, scratch, table

END_ID = 1
#: The settings of the files whose texts may be encoded stretch by stretch.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("n", "<u4")])


def _hash(key: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(key, seed)


def key_bytes(key: int | None, nth: int = 0) -> bytes:
    """A key is an id and which of its repeated rows is meant; a null id is a key of its own."""
    return b"null/%d" % nth if key is None else b"%d/%d" % (key, nth)


def build_mph(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement by bucket, slot by key) of a minimal perfect hash by hash and displace, the fullest buckets first."""
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(n // 4 + 1)]
    for i, k in enumerate(keys):
        buckets[_hash(k, 0) % len(buckets)].append(i)
    taken, slots, shifts = bytearray(n), np.zeros(n, np.int64), np.zeros(len(buckets), "<u4")
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        if not buckets[b]:
            break
        d = 0
        while True:
            d += 1
            at = [_hash(keys[i], d) % n for i in buckets[b]]
            if len(set(at)) == len(at) and not any(taken[s] for s in at):
                break
        shifts[b] = d
        for i, s in zip(buckets[b], at, strict=True):
            taken[s], slots[i] = 1, s
    return shifts, slots


def publish(fs: pyarrow.fs.FileSystem, temp: str, name: str) -> None:
    """Renames; where a file system won't replace what an earlier attempt of the task left, that equal file stays."""
    try:
        fs.move(temp, name)
    except OSError:
        if fs.get_file_info(name).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(temp)


class Shard:
    """Reader of one shard: get(key) in constant time, from the index and one slice of the payload."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.ids = fs.open_input_file(path)
        size = self.ids.size()
        at = int.from_bytes(self.ids.read_at(8, size - 8), "little")
        head, _, body = self.ids.read_at(size - 8 - at, at).partition(b"\n")
        self.head = json.loads(head)
        self.shifts = np.frombuffer(body, "<u4", self.head["buckets"])
        self.slots = np.frombuffer(body, SLOT, self.head["keys"], 4 * self.head["buckets"])
        self.keys = [None] * self.head["nulls"] + np.frombuffer(body, "<i8", self.head["keys"] - self.head["nulls"], 4 * self.head["buckets"] + SLOT.itemsize * self.head["keys"]).tolist()
        self.kind = np.dtype(self.head["kind"])

    def find(self, key: int | None, nth: int = 0) -> tuple[int, int] | None:
        """(start, n) in ids, or None for a key that isn't there."""
        if not len(self.slots):
            return None
        k = key_bytes(key, nth)
        s = self.slots[_hash(k, int(self.shifts[_hash(k, 0) % len(self.shifts)])) % len(self.slots)]
        return (int(s["start"]), int(s["n"])) if s["fingerprint"] == _hash(k, 1 << 40) & 0xFFFFFFFF else None

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        at = self.find(key, nth)
        if at is None:
            return None
        return np.frombuffer(self.ids.read_at(at[1] * self.kind.itemsize, at[0] * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.ids.close()


class ChunkEncoder:
    """Encodes with a tokenizers file; each different stretch between spaces and line feeds is encoded once a block of texts.

    That is the same as encoding the whole text for tokenizers whose normaliser and pre-tokeniser drop white space, never
    join what it separates, take runs of letters by themselves and lower the case; the query's file is one such, and the
    tests compare both. A file with another normaliser or pre-tokeniser has its texts encoded whole. So a comma or full stop that ends a stretch after a Latin letter is a stretch of its own, and
    texts all of ASCII are lower-cased at once, unless they may spell a special token. Stretches of Latin letters,
    in lower case, are pre-tokens; with their bytes spelled as the vocabulary does, they go straight to the model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {i: spell.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x250) if chr(i).isalpha()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = spec | {"normalizer": None, "pre_tokenizer": None}
        self.by_stretch = (spec.get("normalizer"), spec.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER) and not spec.get("post_processor")
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(bare))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def stretches(self, texts: pa.Array) -> pa.ListArray:
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        texts = pc.replace_substring_regex(texts, "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])([ \n])", r"\1 \2\3")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def ids_of(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches one after another, how many each has)."""
        # of these letters, each has one lower-case form, by itself and wherever it stands
        low = [x.lower() if x.isalpha() and max(x) < "\u0250" else "" for x in stretches]
        flags = [x.isalpha() and x.islower() for x in low]
        letters = np.array(flags, bool)
        counts, found = np.zeros(len(stretches), np.int64), []
        bare = None
        if letters.any():
            words = [x if x.isascii() else x.translate(self.spelling) for x, y in zip(low, flags, strict=True) if y]
            bare = self.bare.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        if bare is not None:
            counts[letters] = np.bincount(np.array(bare.word_ids, np.int64), minlength=int(letters.sum()))
        for i, e in zip(np.nonzero(~letters)[0].tolist(), self.tokenizer.encode_batch_fast([x for x, y in zip(stretches, flags, strict=True) if not y], add_special_tokens=False), strict=True):
            found += e.ids
            counts[i] = len(e.ids)
        out, of_letters = np.zeros(counts.sum(), self.kind), np.repeat(letters, counts)
        out[of_letters] = np.array(bare.ids if bare is not None else [], self.kind)
        out[~of_letters] = np.array(found, self.kind)
        return out, counts

    def encode(self, texts: pa.Array, end_id: int = END_ID, block: int = 1 << 24) -> Iterator[np.ndarray]:
        """The ids of each text and the end id; texts are taken in blocks of about `block` bytes, or one longer text."""
        if not self.by_stretch:
            for t in texts.to_pylist():
                yield np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end_id], self.kind)
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block, "right")))
            lists = self.stretches(texts.slice(at, to - at))
            coded = lists.flatten().dictionary_encode()
            ids, counts = self.ids_of(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy(zero_copy_only=False)
            n = counts[which]
            ends = np.cumsum(n)
            starts = (np.cumsum(counts) - counts)[which]
            out = ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            ends = np.concatenate([[0], ends])
            bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield np.append(out[a:b], self.kind.type(end_id))
            at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_token_files(df: DataFrame, out_uri: str, encode: Callable[[], ChunkEncoder], id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes df as shards under out_uri, in ascending order of the id (null first), and returns the manifest:
    (shard, uri, n_docs, n_tokens, base), base being the ids in all shards before. One row a shard; empty shards too.
    A shard numbers its rows of one id from 0, in its own order.
    """
    shards = shards or row_splits(df)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, enc = context.partitionId(), encode()
        fs, root = pyarrow.fs.FileSystem.from_uri(out_uri)
        fs.create_dir(root, recursive=True)
        name, temp = f"{root}/shard-{number:05d}", f"{root}/_temp-{number:05d}-{context.taskAttemptId()}"
        keys, listed, counts, last, nth = [], [], [], object(), 0
        with fs.open_output_stream(temp) as f:
            for b in batches:
                for key, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                    nth = nth + 1 if key == last else 0
                    last = key
                    f.write(ids.tobytes())
                    keys.append(key_bytes(key, nth))
                    listed.append(key)
                    counts.append(len(ids))
            shifts, at = build_mph(keys)
            slots = np.zeros(len(keys), SLOT)
            n = np.array(counts, np.int64)
            slots["start"][at], slots["n"][at] = np.cumsum(n) - n, n
            slots["fingerprint"][at] = [_hash(k, 1 << 40) & 0xFFFFFFFF for k in keys]
            f.write(json.dumps({"keys": len(keys), "buckets": len(shifts), "nulls": listed.count(None), "kind": enc.kind.str}).encode() + b"\n" + shifts.tobytes() + slots.tobytes() + np.array([k for k in listed if k is not None], "<i8").tobytes())
            f.write((int(n.sum()) * enc.kind.itemsize).to_bytes(8, "little"))
        publish(fs, temp, name)
        yield pa.RecordBatch.from_pydict({"shard": [number], "uri": [f"{out_uri}/shard-{number:05d}"], "n_docs": [len(keys)], "n_tokens": [int(n.sum())]})

    order = ["id", F.xxhash64("t"), "t"]  # rows of one id, or without one, are many ranges where they are many
    ordered = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    manifest = materialize(ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long"), "manifest")
    done = sorted(manifest.collect())  # a row a shard
    bases = np.cumsum([0, *[r["n_tokens"] for r in done]]).tolist()
    return df.sparkSession.createDataFrame([(*r, base) for r, base in zip(done, bases, strict=False)], "shard long, uri string, n_docs long, n_tokens long, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every key in the shards of a manifest, looked up in the files key by key."""
    names = ["id", "start", "n_tokens", "ids_crc32"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, last, nth, out = Shard(uri), object(), 0, []
                for key in shard.keys:
                    nth = nth + 1 if key == last else 0
                    last = key
                    start, count = shard.find(key, nth)
                    out.append((key, base + start, count, zlib.crc32(shard.get(key, nth).astype("<u4").tobytes())))
                    if len(out) == 4096:
                        yield batch(out)
                        out = []
                shard.close()
                if out:
                    yield batch(out)

    return manifest.select("uri", "base").repartition(max(1, manifest.count())).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, scratch(spark, "token-files"), lambda: encoder(path))
    return read_token_files(manifest).withColumnRenamed("id", "doc_id")
