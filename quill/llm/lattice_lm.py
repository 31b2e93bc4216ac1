"""LM scoring (4): a unigram model of words over a subword lattice.

A word's probability is the marginal over all its segmentations into pieces of an existing subword vocabulary: a
log-space forward recursion over the lattice of the word's bytes. Pieces that begin a word carry the space before it, so
lattices meet only at word boundaries, and the marginal of a document is the product of its words' marginals and that
of its end. The vocabulary file's scores are those of a merge list (minus the rank), not log probabilities; they give
the weights to begin with, by Zipf's law of the rank, and the expected counts of a forward-backward pass over all the
words learned from turn them into log probabilities. Single bytes are pieces too, so every text has a probability. All
pieces take part, however long, and words of any length, in tables of bounded size.

On top of the pieces, whole words are edges of the lattice as well, with absolutely discounted counts; the discounted
mass goes to the piece paths: P(w) = max(c - D, 0) / N + (D V / N) P_pieces(w), and P sums to one over all words. D is
n1 / (n1 + 2 n2), of the words counted once and twice.

There is one such model for each class of the texts learned from (their language), and a text is a mixture: its class is
unknown, and its probability is the sum over all classes of the class's share times the probability it gives the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialize, table
from .quality import fold

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places of words, all bytes of all words, that a lattice's table has at a time.
CELLS = 1 << 18
#: Bytes of different words, as batches bring them, or of the texts' lists of words, or texts, after which a block is full.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 23, 1 << 15
#: Stands for the end of a text; no word holds white space.
END = b"\n"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, log weights) of a sentencepiece file: words begin with a space; bytes that are no piece come last."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            b = sp.id_to_piece(i).replace("▁", " ").encode().translate(LOWER)
            if b and b" " not in b[1:]:
                pieces[b] = max(pieces.get(b, -np.inf), sp.get_score(i))
    last = float(len(pieces))
    for x in range(256):
        pieces.setdefault(bytes([x]), -last)
    weight = 1 / (10 - np.array(list(pieces.values())))
    return list(pieces), np.log(weight / weight.sum())


class Lattice:
    """Pieces with log probabilities. Substrings of many words are looked up at once by a polynomial hash, and compared
    with the piece's bytes where they meet one."""

    def __init__(self, names: list[bytes], logs: np.ndarray):
        self.logs = logs
        self.sizes = np.array(sorted({len(b) for b in names}))
        longest = int(self.sizes[-1])
        self.powers = np.cumprod(np.full(longest + 1, BASE))
        h = np.array([self._hash(b) for b in names], np.uint64)
        # the bytes of each piece, eight at a time from its end
        self.tails = np.array([[int.from_bytes(b[max(0, len(b) - k - 8) : max(0, len(b) - k)], "big") for b in names] for k in range(0, longest, 8)], np.uint64)
        self.size = 20
        while True:  # a table of one slot a key, large enough for few keys to share one; those are kept apart
            slot = self._slot(h)
            first = np.full(1 << self.size, -1, np.int32)
            first[slot[::-1]] = np.arange(len(names), dtype=np.int32)[::-1]
            rest = np.nonzero(first[slot] != np.arange(len(names)))[0]
            second = np.full(1 << self.size, -1, np.int32)
            second[slot[rest]] = rest
            if (second[slot[rest]] == rest).all():
                break
            self.size += 1
        self.keys, self.first, self.second = h, first, second

    def _hash(self, b: bytes) -> int:
        out = 0
        for x in b:
            out = (out * int(BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.size)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        slot = self._slot(h)
        a = self.first[slot]
        out = np.where(self.keys[a] == h, a, -1)
        b = self.second[slot]
        return np.where((out < 0) & (b >= 0) & (self.keys[b] == h), b, out)

    def edges(self, grid: np.ndarray, backward: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """grid: words of one length, a row each. (end, the pieces that end there: a row for each size that fits, a column
        for each word, -1 where there is none), for every end from the first or from the last. Tables of bounded size."""
        n, t = grid.shape
        prefix, packed = np.zeros((t + 1, n), np.uint64), np.zeros((t + 1, n), np.uint64)
        for i in range(t):
            byte = grid[:, i].astype(np.uint64)
            prefix[i + 1] = prefix[i] * BASE + byte + np.uint64(1)
            packed[i + 1] = (packed[i] << np.uint64(8)) | byte
        step = max(1, CELLS // n)
        for lo in sorted(range(1, t + 1, step), reverse=backward):
            hi = min(t + 1, lo + step)
            table = np.full((hi - lo, len(self.sizes), n), -1, np.int32)
            for k, size in enumerate(self.sizes.tolist()):
                at = max(lo, size)
                if at < hi:
                    ids = self.find(prefix[at:hi] - prefix[at - size : hi - size] * self.powers[size - 1])
                    self.check(ids, packed[: hi], at, size)
                    table[at - lo :, k] = ids
            for end in sorted(range(lo, hi), reverse=backward):
                yield end, table[end - lo, : np.searchsorted(self.sizes, end, "right")]

    def check(self, ids: np.ndarray, packed: np.ndarray, at: int, size: int) -> None:
        """Sets ids (of ends from `at` on) to -1 where the bytes aren't the piece's."""
        i, j = np.nonzero(ids >= 0)
        for k in range(0, size, 8):
            bytes_here = min(8, size - k)
            mask = np.uint64((1 << (8 * bytes_here)) - 1)
            wrong = (packed[i + at - k, j] & mask) != self.tails[k // 8][ids[i, j]]
            ids[i[wrong], j[wrong]] = -1
            if wrong.any():
                i, j = i[~wrong], j[~wrong]

    def forward(self, edges: Iterable[tuple[int, np.ndarray]], t: int, n: int, logs: np.ndarray | None = None) -> np.ndarray:
        """alpha[end]: log of the summed weights of all segmentations of the first `end` bytes of n words of t bytes."""
        logs = np.append(self.logs if logs is None else logs, -np.inf)  # the last one is that of no piece
        alpha = np.full((t + 1, n), -np.inf)
        alpha[0] = 0
        for end, ids in edges:
            terms = logs[ids] + alpha[end - self.sizes[: len(ids)]]
            top = terms.max(axis=0)
            alpha[end] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def marginals(self, words: list[bytes], weights: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural-log marginal of each word, its leading space added; a row for each of the weights (log probabilities of the pieces)."""
        weights = weights or [self.logs]
        out = np.zeros((len(weights), len(words)))
        for at, grid in by_length(words):
            n, t = grid.shape
            edges = list(self.edges(grid)) if n * t <= CELLS else None
            for k, logs in enumerate(weights):  # the lattice of a very long word is built anew each time, not kept
                out[k, at] = self.forward(edges or self.edges(grid), t, n, logs)[-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected count of each piece, each word counting once."""
        counts = np.zeros(len(self.logs))
        logs = np.append(self.logs, -np.inf)
        for _, grid in by_length(words):
            n, t = grid.shape
            kept = list(self.edges(grid)) if n * t <= CELLS else None
            alpha = self.forward(kept or self.edges(grid), t, n)
            beta = np.full((t + 1, n), -np.inf)
            beta[t] = 0
            for end, ids in reversed(kept) if kept else self.edges(grid, backward=True):
                step = logs[ids] + beta[end]
                share = np.exp(step + alpha[end - self.sizes[: len(ids)]] - alpha[t])
                some = ids >= 0
                counts += np.bincount(ids[some], share[some], len(counts))
                for size, row in zip(self.sizes.tolist(), step, strict=False):
                    beta[end - size] = np.logaddexp(beta[end - size], row)
        return counts


def by_length(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of bytes) of words of equal length, with their leading space, in pieces of bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.nonzero(np.diff(sizes[order]))[0] + 1
    for at in np.split(order, cuts) if len(order) else []:
        size = int(sizes[at[0]])
        for s in range(0, len(at), step := max(1, most // (size + 1))):
            part = at[s : s + step]
            grid = np.full((len(part), size + 1), 32, np.uint8)
            if size:
                grid[:, 1:] = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(len(part), size)
            yield part, grid


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Fewer and larger batches: lattices are built for words of one length at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokens(batch_column) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, tokens) of a column of binary texts, lower-cased, with an end token a text."""
    lists = [(*t.translate(LOWER).split(), END) if t else (END,) for t in batch_column.to_pylist()]
    rows = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
    return rows, pa.array([w for x in lists for w in x], pa.binary())


def learn(docs: DataFrame, vocab_path: str, classes: list[int]) -> tuple[DataFrame, int, int, np.ndarray]:
    """docs: columns class (its number, -1 for rows not learned from) and text. classes: documents learned from, by class.

    Returns all texts' words with their count c and, by class, log10 probabilities p0, p1, ... (to float precision); N; V;
    log10 of the classes' shares.
    """
    n_classes = len(classes)
    names, logs = vocabulary(vocab_path)
    sums = [f"c{k}" for k in range(n_classes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                at, tokens = _tokens(part.column(1))
                coded = tokens.dictionary_encode()
                ids, width, kind = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary), np.asarray(part.column(0))[at]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(np.bincount(ids[kind == k], minlength=width), pa.int64()) for k in range(n_classes))], names=["word", *sums])

    rows = docs.select("class", F.col("text").cast("binary").alias("t"))
    counts = rows.mapInArrow(count, ", ".join(["word binary", *(f"{c} long" for c in sums)])).groupBy("word").agg(*[F.sum(c).alias(c) for c in sums])
    counts = materialize(counts, "counts")
    whole = sum((F.col(c) for c in sums[1:]), F.col(sums[0]))
    facts = [x for c in (whole, *map(F.col, sums)) for x in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2))]
    facts = np.array(counts.agg(*[x.alias(f"x{i}") for i, x in enumerate(facts)]).first(), np.float64).reshape(-1, 4)
    total, distinct = int(facts[0, 0]), int(facts[0, 1])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, found = Lattice(names, logs), np.zeros((n_classes, len(names)))
        for b in gathered(batches):
            words = np.array(b.column(0).to_pylist(), object)
            for k in range(n_classes):
                found[k] += lattice.expected(words[np.asarray(b.column(1 + k)) > 0].tolist())
        k, piece = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(found[k, piece])], names=["class", "piece", "n"])

    # at most one row for each class and piece of the vocabulary
    learned = np.zeros((n_classes, len(names)))
    for r in counts.where(F.col("word") != F.lit(END)).mapInArrow(expect, "class long, piece long, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).collect():
        learned[r["class"], r["piece"]] = r["n"]
    learned = np.round(learned, 6) + 0.01
    weights = list(np.log(learned / learned.sum(axis=1, keepdims=True)))
    discounts = [min(0.95, max(0.05, f[2] / max(1, f[2] + 2 * f[3]))) for f in facts[1:]]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names, logs)
        for b in gathered(batches):
            words = b.column(0).to_pylist()
            c = np.array([np.asarray(b.column(1 + k)) for k in range(n_classes)], np.float64)
            every = c.sum(axis=0)
            ends = np.array([w == END for w in words], bool)
            spelled = lattice.marginals(words, weights) / np.log(10)
            out = []
            for k in range(n_classes):
                n, seen = facts[1 + k, 0], facts[1 + k, 1]
                if not n:  # nothing learned: each text ends with a probability of one half at each word
                    out.append(np.where(ends, np.log10(0.5), np.log10(0.5) + spelled[k]))
                    continue
                rest = np.where(ends, -np.inf, np.log10(discounts[k] * seen / n) + spelled[k])
                with np.errstate(divide="ignore"):
                    out.append(np.logaddexp2(np.log2(np.maximum(c[k] - discounts[k], 0) / n), rest * np.log2(10)) * np.log10(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(every.astype(np.int64)), *(pa.array(x.astype(np.float32)) for x in out)], names=["word", "c", *(f"p{k}" for k in range(n_classes))])

    priced = counts.mapInArrow(price, ", ".join(["word binary", "c long", *(f"p{k} float" for k in range(n_classes))]))
    share = np.array(classes, np.float64)
    return priced, total, distinct, np.log10(share / share.sum())


def score(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", folds: int = 10, most: int = 8) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    class_col sorts the texts learned from into classes: each of the `most` most frequent values is one, all others and
    null together another. It is read of those texts alone and is no input of a score. Null and empty texts are one end
    token. Rows with a null id are held out of nothing: they are learned from. Repeated rows count as often as they
    come. Texts are indexed in blocks of bounded size, and each block's list of words meets the counts of all words in one
    shuffle, by word; what a block gathers is as large whatever the size of the corpus. No table of all words is ever held
    by a task or sent to the driver.
    """
    held_out = F.coalesce(fold(id_col, folds) == 0, F.lit(False))
    label = F.lit(None).cast("string") if class_col is None else F.col(class_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("out"), label.alias("label"), F.col(text_col).alias("text"))
    sizes = rows.where(~F.col("out")).groupBy("label").count()
    named = sizes.where("label IS NOT NULL").orderBy(F.desc("count"), "label").limit(most).collect()
    others = (sizes.agg(F.sum("count")).first()[0] or 0) - sum(r["count"] for r in named)
    classes = [*(r["count"] for r in named), *([others] if others or not named else [])]
    number = F.lit(len(named))
    for k, r in enumerate(named):
        number = F.when(F.col("label").eqNullSafe(F.lit(r["label"])), k).otherwise(number)
    number = F.when(F.col("out"), -1).otherwise(number).cast("int")
    priced, total, distinct, shares = learn(rows.select(number.alias("class"), "text"), vocab_path, [c or 1 for c in classes])
    priced = materialize(priced, "priced")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of texts, each with a list of its words: a row a text (which words, how often) and a row a word."""
        task = TaskContext.get().partitionId() << 24
        place, held, texts = {}, 0, 0

        def listed(first: int) -> Iterator[pa.RecordBatch]:
            names = list(place)
            for s in range(0, len(names), 1 << 16):
                part = names[s : s + (1 << 16)]
                n = len(part)
                yield block(np.full(n, task + first), [None] * n, [None] * n, [None] * n, [None] * n, np.arange(s, s + n), part)

        def block(at, ids, out, which, n, at_word, words) -> pa.RecordBatch:
            cols = [pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(which, pa.binary()), pa.array(n, pa.binary()), pa.array(at_word, pa.int32()), pa.array(words, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "id", "out", "which", "n", "place", "word"])

        first = 0
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                at, tokens = _tokens(part.column(2))
                coded = tokens.dictionary_encode()
                names = coded.dictionary.to_pylist()
                own = np.fromiter((place.setdefault(w, len(place)) for w in names), np.int64, len(names))
                both, n = np.unique(at * (1 << 40) + own[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                cut = np.searchsorted(both >> 40, np.arange(part.num_rows + 1))
                which = [packed(both[x:y] & ((1 << 40) - 1)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                often = [packed(n[x:y], False) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                k = part.num_rows
                yield block(np.full(k, task + first), part.column(0), part.column(1), which, often, [None] * k, [None] * k)
                held += max(sum(map(len, names)), sum(map(len, which)) + sum(map(len, often)))
                texts += k
                if held > BLOCK_BYTES or texts >= BLOCK_TEXTS:
                    yield from listed(first)
                    place, held, texts, first = {}, 0, 0, first + 1
        if place:
            yield from listed(first)

    indexed = materialize(
        rows.select("id", "out", F.col("text").cast("binary").alias("t")).mapInArrow(index, "block long, id long, out boolean, which binary, n binary, place int, word binary"), "indexed"
    )
    pairs = indexed.where("word IS NOT NULL").select("block", "place", "word").join(priced.hint("shuffle_hash"), "word").drop("word")
    texts = indexed.where("word IS NULL").select(F.col("block").alias("of_block"), "id", "out", "which", "n")
    kinds = len(shares)

    def add_up(texts: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
        c, p = np.zeros(len(prices)), np.zeros((kinds, len(prices)))
        at = prices["place"].to_numpy()
        c[at] = prices["c"]
        for k in range(kinds):
            p[k, at] = prices[f"p{k}"]
        base, known = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), c > 0
        out = []
        for i, held, which, n in zip(texts["id"], texts["out"], texts["which"], texts["n"], strict=True):
            which, n = unpacked(which), unpacked(n, False)
            by_class = p[:, which] @ n + shares
            best = by_class.max()
            out.append((i, held, int(n.sum()), int(n[known[which]].sum()), total, float(base[which] @ n), float(best + np.log10((10.0 ** (by_class - best)).sum()))))
        return pd.DataFrame(out, columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).astype({"id": "Int64"})

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("of_block").cogroup(pairs.groupBy("block")).applyInPandas(add_up, schema)


def packed(x: np.ndarray, rising: bool = True) -> bytes:
    """Whole numbers, as differences if they rise, by planes of bytes, compressed."""
    x = np.diff(x, prepend=0) if rising else x
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes, rising: bool = True) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(x) if rising else x


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")
