"""Cross-tokenizer alignment (13): an interval index over B's tokens, stabbed by each of A's.

Both tokenizers cut the same bytes, so their tokens are intervals on one line. B's starts and ends are the static index:
two bisections give the run of B tokens that an A token overlaps, and all A tokens of a text are looked up at once. The
gaps between B tokens that no A token spans are the bounds of groups, the smallest stretches that both cut the same way.

How often two ids are linked is counted by documents over the whole table. A document's different links and how often it
has each are stored once; their counts come from partial sums by task. To bring the counts back, links so common that only
HOT of them can exist go to all tasks, where they are summed per document as they lie; only the rest is exploded, joined
and summed, so that no common link meets in one task and little is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced, table
from .stretches import StretchEncoder, byte_level, pieces

#: A link that more than one in HOT of all (document, link) rows has is hot, so there are fewer than HOT of them.
HOT = 100_000
#: Different links that a counting task holds before it sends their counts on.
HELD = 1 << 20
LINKS = "uid long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"


def spelled(bytes_of: dict[int, bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(length in bytes, bytes) by id."""
    listed = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
    return np.array([len(x) for x in listed], np.int64), listed


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) B token, by index, that each A token overlaps; a and b: lengths in bytes of tokens of the same bytes."""
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    first = np.searchsorted(b_ends, a_ends - a, "right")
    return first, np.searchsorted(b_ends - b, a_ends, "left") - 1


def group_of(first: np.ndarray, last: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token: a new one begins after a B token whose gap no A token spans."""
    spans = np.bincount(first, minlength=n_b + 1) - np.bincount(last, minlength=n_b + 1)
    of_b = np.concatenate([[0], np.cumsum(np.cumsum(spans[: n_b - 1]) == 0)])
    return of_b[first], of_b


class Aligner:
    """Groups and links of texts from the ids of two encoders."""

    def __init__(self, a: StretchEncoder, b: StretchEncoder):
        self.sides = []
        for e, inner, outer in ((a, ",", "|"), (b, ",", ";")):
            lengths, listed = spelled(e.bytes_of)
            numbers = [str(i) for i in range(len(listed))]
            self.sides.append((lengths, listed, np.array([x + inner for x in numbers], object), np.array([x + outer for x in numbers], object)))

    def same(self, ids: np.ndarray, side: int, want: bytes) -> bool:
        lengths, listed = self.sides[side][:2]
        return lengths[ids].sum() == len(want) and b"".join(map(listed.__getitem__, ids.tolist())) == want

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray, np.ndarray]:
        """(groups, SHA-256 of their text, A index by link, B index by link)."""
        first, last = overlaps(self.sides[0][0][a], self.sides[1][0][b])
        n = last - first + 1
        of_a = np.repeat(np.arange(len(a)), n)
        of_b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        in_a, in_b = group_of(first, last, len(b))
        parts = []
        for (_, _, inner, outer), ids, of in zip(self.sides, (a, b), (in_a, in_b), strict=True):
            parts.append(np.where(np.append(of[1:] != of[:-1], True), outer[ids], inner[ids]))
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        text = "".join(np.concatenate(parts)[order].tolist())[:-1]
        return int(in_b[-1]) + 1, hashlib.sha256(text.encode()).hexdigest(), of_a, of_b


def align_texts(docs: DataFrame, encode_a: Callable[[], StretchEncoder], encode_b: Callable[[], StretchEncoder], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """LINKS for every row: counts of tokens, groups and links, the digest of the groups, the different links (A id times
    2^32 plus B id, ascending, as 8-byte integers) and how often the row has each (8 bytes). uid tells rows apart.

    A encodes a space and the text, B adds its own. Null and empty texts, and those of which one tokenizer doesn't give the
    bytes back, have no tokens: zeros, '' and no links. Each text is aligned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_a, enc_b = encode_a(), encode_b()
        aligner = Aligner(enc_a, enc_b)
        for b in sliced(batches, 1024):
            spaced = [" " + t if t else "" for t in b.column(2).to_pylist()]
            a_ids, a_at = enc_a.batch(pa.array(spaced, pa.string()))
            b_ids, b_at = enc_b.batch(b.column(2))
            rows = []
            for i, t in enumerate(spaced):
                a, z = a_ids[a_at[i] : a_at[i + 1]], b_ids[b_at[i] : b_at[i + 1]]
                want = t.encode()
                if not t or not (aligner.same(a, 0, want) and aligner.same(z, 1, want)):
                    rows.append((0, 0, 0, 0, "", b"", b""))
                    continue
                n, digest, of_a, of_b = aligner.align(a, z)
                links, times = np.unique(a.astype(np.int64)[of_a] << 32 | z.astype(np.int64)[of_b], return_counts=True)
                rows.append((len(a), len(z), n, len(of_a), digest, links.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
            got = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=[c.split()[0] for c in LINKS.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, LINKS)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): in how many rows each link is, and whether no link of its A id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            every, inverse = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            weights = np.concatenate([sums, np.ones(len(inverse) - len(sums), np.int64)])
            return every, np.bincount(inverse, weights, len(every)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["link", "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                waiting.append(np.frombuffer(raw, "<i8"))
                held += len(waiting[-1])
                if held > HELD:
                    keys, sums = merge()
                    waiting, held = [], 0
                    if len(keys) > HELD:
                        yield out()
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merge()
        yield out()

    counts = aligned.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "link-counts")
    most = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright(counts["link"], 32) == most["a"]).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """aligned (a stored table) with n_best, the row's links of which `best` holds, and count_sum, the sum of their counts.
    counts: a stored table of link_counts()."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") > total / hot).toArrow()  # fewer than `hot` rows
    order = np.argsort(common["link"].to_numpy())
    known = aligned.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy()[order] for c in ("link", "n", "best")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's hot links summed (link null), its others one by one."""
        links, ns, best = known.value
        for b in sliced(batches, 256):
            got = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            uid = np.repeat(b.column(0).to_numpy(), [len(x) for x in got])
            link, times = np.concatenate([np.zeros(0, np.int64), *got]), np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<i8") for x in b.column(2).to_pylist()]])
            at = np.minimum(np.searchsorted(links, link), max(0, len(links) - 1))
            found = links[at] == link if len(links) else np.zeros(len(link), bool)
            rows, of = np.unique(uid[found], return_inverse=True)
            n, best_n = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(n, of, ns[at[found]] * times[found])
            np.add.at(best_n, of, best[at[found]] * times[found])
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows), none, none, pa.array(best_n), pa.array(n)], names=["uid", "link", "times", "n_best", "count_sum"])
            rest = ~found
            none = pa.nulls(int(rest.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(uid[rest]), pa.array(link[rest]), pa.array(times[rest]), none, none], names=["uid", "link", "times", "n_best", "count_sum"])

    parts = materialize(aligned.where("n_links > 0").select("uid", "links", "times").mapInArrow(split, "uid long, link long, times long, n_best long, count_sum long"), "link-parts", compression="zstd")
    rare = counts.where(F.col("n") <= total / hot)
    joined = parts.where("link IS NOT NULL").select("uid", "link", "times").join(rare, "link")
    rare_sums = joined.select("uid", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums = parts.where("link IS NULL").select("uid", "n_best", "count_sum").union(rare_sums).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("links", "times").join(sums, "uid", "left").fillna(0, ["n_best", "count_sum"])


def links_of(aligned: DataFrame) -> DataFrame:
    """(id, a, b, times): the different links of each row, one a row."""

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, links, times in f.itertuples(index=False):
                x = np.frombuffer(links, "<i8")
                yield pd.DataFrame({"id": pd.array([i] * len(x), "Int64"), "a": x >> 32, "b": x & 0xFFFFFFFF, "times": np.frombuffer(times, "<i8")})

    return aligned.select("id", "links", "times").mapInPandas(explode, "id long, a long, b long, times long")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    aligned = materialize(align_texts(table(spark, sf_dir, "documents"), lambda: byte_level(a, pattern, False), lambda: pieces(b)), "aligned", compression="zstd")
    counts = materialize(link_counts(aligned), "counts")
    out = with_counts(aligned, counts)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
