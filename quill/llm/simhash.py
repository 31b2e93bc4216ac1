"""SimHash near-dedup (8).

Fingerprints: 64 bits, a bit set where over half of a text's shingle hashes have it. Linking: two fingerprints that
differ in at most 3 bits agree on at least one of 4 blocks of 16 bits (on 2 of 5 blocks, 3 of 6: more for more codes),
so every fingerprint is dealt to the groups of its blocks' values. A task puts the blocks that its groups share into the
highest bits, sorts the codes of all its groups by Gray rank and builds one hierarchical index over them: neighbours in
Gray order share long bit patterns; each node keeps the bits that all its codes share (a mask and a pattern), less those
of its parent. A search enters at the lowest nodes that span its group, adds up the differences on the way down, and
drops a whole node beyond the threshold. Every pair of every group is found so, whatever the group's size.

Groups over a limit are dealt out in pairs of chunks. Tasks return spanning forests, never all pairs, and codes of a
tree that is already joined are pruned with their node. Components come from rounds of star joins over files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Forest, components, give_back, join_hot, materialize, sliced, table

FANOUT = 8


def shingle_hashes(text: bytes, k: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence if there are fewer words; none if no word."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, "<u8")
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([digest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: len(w) - k] + 1).tolist()]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")


def simhash(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    h = shingle_hashes(text or b"", k, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp as a signed 64-bit long) of every row; a null or empty text has fingerprint 0."""
    return prints(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")), k)


def prints(rows: DataFrame, k: int = 3) -> DataFrame:
    """rows: long columns, then the text t as binary; with fp in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([simhash(t, k) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=[*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*rows.columns[:-1], "fp"]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the reflected Gray sequence: the prefix xor of its bits."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of nodes over codes in Gray order, from the leaves (the codes) up; FANOUT neighbours share a node.

    full[l], pat[l]: at level l, the mask of the bits that all codes of a node share, and their values. own[l]: those of
    the mask that the node's parent does not share. visited counts the nodes that searches have compared.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order].astype(np.uint64)
        self.full, self.pat = [np.full(len(codes), 0xFFFFFFFFFFFFFFFF, np.uint64)], [self.codes]
        while len(self.full[-1]) > FANOUT:
            at = np.arange(0, len(self.full[-1]), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(self.pat[-1] & self.full[-1], at), np.bitwise_and.reduceat(~self.pat[-1] & self.full[-1], at)
            self.full.append(ones | zeros)
            self.pat.append(ones)
        self.own = [m & ~self.full[i + 1][np.arange(len(m)) // FANOUT] if i + 1 < len(self.full) else m for i, m in enumerate(self.full)]
        self.visited = 0

    def search(self, queries: np.ndarray, first: np.ndarray, last: np.ndarray, most: int, q_tree: np.ndarray | None = None, tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of the codes within `most` bits of each query, among positions first to last - 1.

        A query enters at the lowest nodes that span its positions, adds up its differences from the shared patterns on
        the way down, and drops a node with all below it once they exceed `most`. With trees (a label per query and per
        code), pairs of one tree are left out, nodes of one tree whole.
        """
        top = len(self.own) - 1
        enter = np.zeros(len(queries), np.int64)
        for level in range(top):
            enter += last - first > FANOUT**level
        spans = None
        if tree is not None:
            spans = [(tree, tree)]
            for _ in range(top):
                at = np.arange(0, len(spans[-1][0]), FANOUT)
                spans.append((np.minimum.reduceat(spans[-1][0], at), np.maximum.reduceat(spans[-1][1], at)))
        q = node = acc = np.zeros(0, np.int64)
        for level in range(top, -1, -1):
            width = FANOUT**level
            new = np.nonzero(enter == level)[0]
            lo = first[new] // width
            n = (last[new] - 1) // width - lo + 1
            new_q = np.repeat(new, n)
            new_node = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(new_q))
            parts = ((q, node, acc, self.own), (new_q, new_node, np.zeros(len(new_q), np.int64), self.full))
            acc = np.concatenate([a + np.bitwise_count((queries[x] ^ self.pat[level][y]) & mask[level][y]) for x, y, a, mask in parts])
            q, node = np.concatenate([q, new_q]), np.concatenate([node, new_node])
            self.visited += len(q)
            keep = acc <= most
            if spans is not None:
                low, high = spans[level]
                keep &= ~((low[node] == high[node]) & (low[node] == q_tree[q]))
            q, node, acc = q[keep], node[keep], acc[keep]
            if level:
                q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                keep = (node >= first[q] // (width // FANOUT)) & (node <= (last[q] - 1) // (width // FANOUT))
                q, node, acc = q[keep], node[keep], acc[keep]
        return q, node


class Trees:
    """Labels of trees over numbered codes, and the pairs that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        some = np.nonzero(x != y)[0]
        if not len(some):
            return
        _, one = np.unique(np.stack([np.minimum(x[some], y[some]), np.maximum(x[some], y[some])], axis=1), axis=0, return_index=True)
        some, forest = some[one], Forest()
        for i, u, v in zip(some.tolist(), x[some].tolist(), y[some].tolist(), strict=True):
            if forest.find(u) != forest.find(v):
                forest.join(u, v)
                self.kept.append((int(a[i]), int(b[i])))
        to = np.arange(len(self.label))
        for u in list(forest.parent):
            to[u] = forest.find(u)
        self.label = to[self.label]


def joined(index: GrayIndex, first: np.ndarray, last: np.ndarray, most: int, allow=None) -> list[tuple[int, int]]:
    """Pairs of positions within `most` bits and within first to last - 1 of each, enough to join all that such pairs join. allow: which of some pairs count."""
    codes, trees = index.codes, Trees(len(index.codes))

    def take(a: np.ndarray, b: np.ndarray) -> None:
        if allow is not None:
            ok = allow(a, b)
            a, b = a[ok], b[ok]
        trees.join(a, b)

    near = np.nonzero((np.bitwise_count(codes[1:] ^ codes[:-1]) <= most) & (first[1:] == first[:-1]))[0]
    take(near, near + 1)
    at, step = 0, 256
    while at < len(codes):  # few queries at first, which join most of a dense group; then more at once
        part = slice(at, at + step)
        q, node = index.search(codes[part], first[part], last[part], most, trees.label[part], trees.label)
        take(q + at, node)
        at, step = at + step, min(2 * step, 4096)
    return trees.kept


def joined_across(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(code of left, code of right) pairs within `most` bits, enough to join all that such pairs join."""
    index, trees = GrayIndex(right), Trees(len(left) + len(right))
    queries, n = left[np.argsort(gray_rank(left), kind="stable")], len(right)
    at, step = 0, 256
    while at < len(queries):
        part = queries[at : at + step]
        q, node = index.search(part, np.zeros(len(part), np.int64), np.full(len(part), n), most, trees.label[n + at : n + at + step], trees.label[:n])
        trees.join(q + at + n, node)
        at, step = at + step, min(2 * step, 4096)
    return [(queries[a - n], index.codes[b]) for a, b in trees.kept]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut between groups of equal first `keys` columns."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [np.asarray(c) for c in b.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]):
            last = np.all([c == c[-1] for c in held[:keys]], axis=0)
            if not last[0]:  # all but the group that may go on in the next batch
                yield [x[~last] for x in held]
                held = [x[last] for x in held]
    if held is not None and len(held[0]):
        yield held
    give_back()


def group_bounds(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    new = np.nonzero(np.any([np.diff(k) != 0 for k in keys], axis=0))[0] + 1
    return np.concatenate([[0], new, [len(keys[0])]])


def choices(most: int, agree: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The ways to choose `agree` of most + agree even blocks of 64 bits: (all blocks' bounds, the chosen ones first; their mask)."""
    at = np.linspace(0, 64, most + agree + 1).astype(int).tolist()
    blocks = list(zip(at, at[1:], strict=False))
    return [([*c, *(b for b in blocks if b not in c)], sum(((1 << (hi - lo)) - 1) << lo for lo, hi in c)) for c in combinations(blocks, agree)]


def arranged(codes: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The codes' blocks in another order, the first one in the highest bits."""
    out = np.zeros(len(codes), np.uint64)
    for lo, hi in blocks:
        out = (out << np.uint64(hi - lo)) | ((codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1))
    return out


def keyed_by(codes: DataFrame, chosen: list[tuple[list[tuple[int, int]], int]]) -> DataFrame:
    """(mask, value, fp): each code under the value of its chosen blocks, for every way to choose them."""
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for _, m in chosen))
    # few bytes become many rows: they are dealt to as many tasks as a shuffle has before that
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = codes.repartition(n, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("mask"))
    return each.select("mask", F.col("fp").bitwiseAND(F.element_at(signed, F.col("mask") + 1)).alias("value"), "fp")


def indexes(mask: np.ndarray, codes: np.ndarray, chosen: list[tuple[list[tuple[int, int]], int]]) -> Iterator[tuple[int, np.ndarray, GrayIndex, np.ndarray, np.ndarray]]:
    """For each mask, one index over all its groups, whose values are the highest bits of the arranged codes: (mask, the
    codes in the index's order, index, and for each code where its group begins and ends)."""
    for m in np.unique(mask).tolist():
        own = codes[mask == m]
        blocks, bits = chosen[m]
        index = GrayIndex(arranged(own, blocks))
        shift = np.uint64(64 - bits.bit_count())
        bounds = group_bounds((index.codes >> shift,))
        sizes = np.diff(bounds)
        yield m, own[index.order], index, np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)


def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def links(codes: DataFrame, most: int = 3, limit: int = 4096, agree: int | None = None) -> DataFrame:
    """codes: column fp, distinct. Returns (a, b) pairs whose components are those of all pairs within `most` bits.
    agree: so many of most + agree blocks are equal in a group; by default as many as keep groups small for that many codes."""
    if agree is None:
        n = codes.count()
        agree = 1 + (n > 1 << 22) + (n > 1 << 30)
    chosen = choices(most, agree)
    keyed = keyed_by(codes, chosen)
    sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (
        keyed.join(sizes, ["mask", "value"])
        .withColumn("chunks", F.ceil(F.col("n") / F.lit(limit)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("mask", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, i, j, own, fp in whole_groups(batches, 4):
            codes, found = fp.view(np.uint64), Forest()
            one = i == j
            for _, names, index, first, last in indexes(mask[one], codes[one], chosen):
                signed = names.view(np.int64)
                for a, b in joined(index, first, last, most):
                    found.join(int(signed[a]), int(signed[b]))
            if not one.all():
                bounds = group_bounds((mask, value, i, j))
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    left = own[s:e] == i[s]
                    if not one[s] and left.any() and not left.all():
                        for a, b in joined_across(codes[s:e][left], codes[s:e][~left], most):
                            found.join(int(a.view(np.int64)), int(b.view(np.int64)))
            yield edges(found.kept)

    key = ["mask", "value", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, k: int = 3, limit: int = 4096) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id of all texts reachable by links of at most `most` bits.

    Texts without words share fingerprint 0. Rows with a null id take part with their text and get the smallest id of
    the others (null if there is none). Repeated rows stay as often as they come; an empty table gives no rows.
    """
    docs = materialize(fingerprints(df, id_col, text_col, k), "fingerprints")
    codes = materialize(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "codes")
    roots = components(links(codes.select("fp"), most, limit))
    joined = codes.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(best, "root").select("fp", "component_id")
    named = materialize(codes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "named")
    return join_hot(docs, named, "fp").select("id", "fp", "component_id")


def near_pairs(codes: DataFrame, most: int, agree: int = 3, forest: bool = False) -> DataFrame:
    """codes: column fp, distinct. All pairs (a, b), a < b, within `most` bits, each once, by the same index: codes meet in
    groups that share `agree` of most + agree blocks. forest: pairs enough to join what the pairs of such groups join."""
    chosen = choices(most, agree)
    bits = np.array([m for _, m in chosen], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, _, fp in whole_groups(batches, 2):
            found: list[tuple[int, int]] = []
            for m, names, index, first, last in indexes(mask, fp.view(np.uint64), chosen):

                def is_first(a: np.ndarray, b: np.ndarray, m=m, names=names) -> np.ndarray:
                    """Whether mask m is the first that both codes are equal under: a pair is taken up there and nowhere else."""
                    out = [np.argmax(((names[a[i : i + 8192]] ^ names[b[i : i + 8192]])[:, None] & bits) == 0, axis=1) for i in range(0, len(a), 8192)]
                    return np.concatenate(out) == m if out else np.zeros(0, bool)

                signed = names.view(np.int64)
                if forest:
                    pairs = joined(index, first, last, most, is_first)
                    found += [(int(signed[a]), int(signed[b])) for a, b in pairs]
                    continue
                for at in range(0, len(names), 1024):
                    part = slice(at, at + 1024)
                    q, node = index.search(index.codes[part], first[part], last[part], most)
                    a, b = (q + at)[q + at < node], node[q + at < node]
                    ok = is_first(a, b)
                    found += zip(signed[a[ok]].tolist(), signed[b[ok]].tolist(), strict=True)
            yield edges(found)

    return keyed_by(codes, chosen).repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """pairs (x, y) of ids whose texts (id, t: binary) have that Jaccard similarity of k-word shingles or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            keep = []
            for t, u in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, v = np.unique(shingle_hashes(t or b"", k)), np.unique(shingle_hashes(u or b"", k))
                both = len(np.intersect1d(s, v, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    first = texts.select(F.col("id").alias("x"), F.col("t").alias("t"))
    second = texts.select(F.col("id").alias("y"), F.col("t").alias("u"))
    return pairs.join(first, "x").join(second, "y").select("x", "y", "t", "u").mapInArrow(run, "x long, y long")


#: Texts sampled, or one in ORDER_RATE if that is more, and shingles named at most, for the order of shared_shingles(): common
#: ones come last. It bears on cost alone; with a smaller part of more texts, shingles of ever more texts would pass for rare.
ORDER_TEXTS, ORDER_RATE, ORDER_SHINGLES, ORDER_LEAST = 8000, 8, 200_000, 5


def text_key(text: Column) -> Column:
    """A 64-bit hash that stands for a text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def common_shingles(texts: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that several of the sampled ones of n texts (node, t) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches):
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t or b"", k)).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(min(ORDER_RATE, max(1, n // ORDER_TEXTS)))) == 0).mapInArrow(run, "h long")
    counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).collect()
    h, c = np.array([r["h"] for r in counts], np.int64).view(np.uint64), np.array([r["n"] for r in counts], np.int64)
    at = np.argsort(h)
    return h[at], c[at]


def prefix(text: bytes, similarity: float, k: int, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(the first shingle hashes of the text in the order of commonness, then hash; how many it has). Two texts of that
    similarity s share at least ceil(s n) of either's n shingles, so n - ceil(s n) + 1 of each can't all be others."""
    h = np.unique(shingle_hashes(text, k))
    n = len(h)
    if not n:
        return h, 0
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
    return h[: n - int(np.ceil(similarity * n - 1e-9)) + 1], n


def shared_shingles(texts: DataFrame, similarity: float, k: int, n: int) -> DataFrame:
    """texts: (node, t). (h, node, n, before, place) of the prefix shingles that several of the texts have: n is the text's
    count of shingles, before the shingle ahead of h in its prefix (the node's own number at the first), place that of h,
    from 0."""
    common, counts = common_shingles(texts, k, n)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches):
            rows = []
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    h, size = prefix(t or b"", similarity, k, common, counts)
                    h = h.view(np.int64)
                    rows.append((h, np.full(len(h), node, np.int64), np.full(len(h), size, np.int32), np.concatenate([[node], h[:-1]]).astype(np.int64)[: len(h)], np.arange(len(h), dtype=np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["h", "node", "n", "before", "place"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node, size, before, place in whole_groups(batches, 1):
            bounds = group_bounds((h,))
            keep = np.repeat(np.minimum.reduceat(node, bounds[:-1]) < np.maximum.reduceat(node, bounds[:-1]), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, node, size, before, place)], names=["h", "node", "n", "before", "place"])

    schema = "h long, node long, n int, before long, place int"
    return texts.mapInArrow(take, schema).repartition("h").sortWithinPartitions("h").mapInArrow(several, schema)


#: Bits of a text's sketch, in words of 64.
SKETCH = [f"b{i}" for i in range(8)]


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """texts: (node, t). (node, words of SKETCH, size, wide), each text once: bits tell whether an odd number of its
    shingles falls on them, so two texts' sketches differ in no more bits than their sets of shingles in shingles. wide
    has about two bits a shingle, a power of two of them; folded, it is the sketch of fewer bits. size counts shingles."""
    bits = 64 * len(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, wide, narrow = [], [], [np.zeros((0, bits), np.uint8)]
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t or b"", k)) >> np.uint64(40)
                odd = (np.bincount(h.astype(np.int64) & ((most := max(bits, 1 << min(20, (2 * len(h)).bit_length()))) - 1), minlength=most) & 1).astype(np.uint8)
                sizes.append(len(h))
                wide.append(np.packbits(odd, bitorder="little").tobytes())
                narrow.append(np.bitwise_xor.reduce(odd.reshape(-1, bits), axis=0)[None])
            words = np.packbits(np.concatenate(narrow), axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(words[:, i]) for i in range(len(SKETCH))), pa.array(sizes, pa.int32()), pa.array(wide, pa.binary())], names=["node", *SKETCH, "size", "wide"])

    schema = ", ".join(f"{c} long" for c in ["node", *SKETCH]) + ", size int, wide binary"
    return texts.mapInArrow(run, schema).groupBy("node").agg(*(F.min(c).alias(c) for c in [*SKETCH, "size", "wide"]))


def allowed(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (x, y) whose wide sketches allow the similarity: the rest differ in too many shingles for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, u, v in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                u, v = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
                while len(u) != len(v):
                    u, v = (u, v) if len(u) > len(v) else (v, u)
                    u = u[: len(u) // 2] ^ u[len(u) // 2 :]
                keep.append(int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    first = sketches.select(F.col("node").alias("x"), F.col("size").alias("n"), F.col("wide").alias("u"))
    second = sketches.select(F.col("node").alias("y"), F.col("size").alias("m"), F.col("wide").alias("v"))
    return pairs.join(first, "x").join(second, "y").select("x", "y", "n", "m", "u", "v").mapInArrow(run, "x long, y long")


def shared_pairs(shared: DataFrame, similarity: float, forest: bool = False) -> DataFrame:
    """shared: (h, node, n, before, place, head, words of SKETCH). Pairs (x, y), x < y, of nodes of different heads that share
    a prefix shingle, and whose counts, places and sketches allow the similarity: all that have it are among them. Where
    the shingle before is the same as well, the pair is met there. At the first shingle that two texts share, neither has
    more shared ones than it has from that place on; a pair that meets too late for the similarity is left to an earlier
    shingle, and has not that similarity if there is none. forest: of those a task holds at once, pairs enough to join the
    heads that its pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, head, node, n, before, place, *words in whole_groups(batches, 1):
            bounds = group_bounds((h,))
            sketch = np.stack(words, axis=1).view(np.uint64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def fits(i: np.ndarray, j: np.ndarray, head=head, n=n, before=before, rest=n - place) -> np.ndarray:
                alike = (head[i] != head[j]) & (before[i] != before[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                return alike & (np.minimum(rest[i], rest[j]) >= (n[i] + n[j]) * similarity / (1 + similarity) - 1e-9)

            def take(i: np.ndarray, j: np.ndarray, n=n, sketch=sketch, left=left, right=right) -> None:
                for at in range(0, len(i), 1 << 15):
                    x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= (n[x] + n[y]) * (1 - similarity) / (1 + similarity) + 1e-9
                    left.append(x[near])
                    right.append(y[near])

            sizes = np.diff(bounds)
            group, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= FANOUT, sizes)
            for s in range(1, min(FANOUT, len(h))):
                i = np.nonzero((group[s:] == group[:-s]) & small[s:])[0]
                i = i[fits(i, i + s)]
                take(i, i + s)
            for g in np.nonzero(sizes > FANOUT)[0].tolist():
                at, end = int(bounds[g]), int(bounds[g + 1])
                while at < end:
                    first = at + int(np.searchsorted(head[at:end], head[at], "right"))  # rows of one head lie together and aren't compared
                    if first == end:
                        break
                    stop = min(end, at + max(1, (1 << 18) // (end - first)))
                    i, j = np.arange(at, stop)[:, None], np.arange(first, end)[None, :]
                    q, r = np.nonzero(fits(i, j) & (i < j))
                    take(at + q, first + r)
                    at = stop
            i, j = np.concatenate(left), np.concatenate(right)
            if forest:
                heads, one = np.unique(np.sort(np.stack([head[i], head[j]], axis=1), axis=1), axis=0, return_index=True)
                joined = Forest()
                one = [k for (x, y), k in zip(heads.tolist(), one.tolist(), strict=True) if joined.find(x) != joined.find(y) and joined.join(x, y) is None]
                i, j = i[one], j[one]
            pairs = np.unique(np.sort(np.stack([node[i], node[j]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    return shared.select("h", "head", "node", "n", "before", "place", *SKETCH).repartition("h").sortWithinPartitions("h", "head").mapInArrow(run, "x long, y long").distinct()


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 5, steps: tuple[int, ...] = (5, 9)) -> DataFrame:
    """(id, node) of one row of each group of near copies: that with the smallest id, node being its text's text_key().

    Groups are the components of all texts under two kinds of links: at most 3 bits between fingerprints, and that
    similarity of k-word shingles or more. Classes come from the first kind. Then the classes' heads are paired within the
    bits of each of `steps` in turn, pairs enough to join the codes of a group, so that a dense group of copies has
    shrunk to few classes; this merges what is similar and leaves nothing out of what follows. Last, all texts of all
    classes that share a shingle of their prefixes are compared, but for those of one class, again by few pairs first; by
    the prefixes' lengths no pair of that similarity is missed. A row with a null id stays only in a group without ids.
    """
    texts = df.select(text_key(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("t"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("t"))
    rows = materialize(prints(rows), "fingerprints")
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"))
    roots = components(links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    classes = nodes.join(roots, "fp", "left").select("node", "fp", F.coalesce("root", "fp").alias("class"))
    heads = classes.groupBy("class").agg(F.min("node").alias("head"))
    named = materialize(classes.join(heads, "class").select("node", "fp", "head"), "classes")
    sketches = materialize(sketched(texts, k), "sketches")

    def merged(pairs: DataFrame) -> DataFrame:
        """named after the similar ones of pairs (x, y) of nodes have merged their classes."""
        pairs = materialize(allowed(pairs, sketches, similarity), "pairs")
        needed = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        found = texts.join(needed, "node").groupBy(F.col("node").alias("id")).agg(F.min("t").alias("t"))
        same = similar(pairs, found, similarity, k)
        of = named.select("node", "head")
        edges = same.join(of.select(F.col("node").alias("x"), F.col("head").alias("a")), "x").join(of.select(F.col("node").alias("y"), F.col("head").alias("b")), "y").select("a", "b")
        to = components(edges).select(F.col("node").alias("head"), "root")
        return materialize(named.join(to, "head", "left").select("node", "fp", F.coalesce("root", "head").alias("head")), "classes")

    for most in steps:
        left = named.where("node = head").groupBy("fp").agg(F.min("node").alias("node"))
        near = near_pairs(left.select("fp"), most, forest=True)
        named = merged(materialize(near.join(left.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(left.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y"), "pairs"))
    shared = materialize(shared_shingles(texts, similarity, k, named.count()), "shared")
    for forest in (True, False):
        held = shared.join(named.select("node", "head").join(sketches.select("node", *SKETCH), "node"), "node")
        named = merged(materialize(shared_pairs(held, similarity, forest), "pairs"))
    least = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("row"))  # one row a text, however many copies it has
    best = least.join(named.select("node", "head"), "node").groupBy("head").agg(F.min(F.struct("row.none", "row.id", "node")).alias("row"))
    return best.select("row.id", "row.node")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
