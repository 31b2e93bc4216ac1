"""Best-fit packing with Martello-Toth dominance reduction (11).

Documents become pieces of at most `capacity` ids; only longer ones are cut, the first piece taking what is left over. How
pieces share sequences depends on their lengths alone, of which there are at most `capacity`, so the plan is made for the
counts of lengths: the driver holds one number a length, whatever the number of documents.

The plan has two parts. Reduction: for each length, longest first, a set with it that dominates all other sets that fit
(each of their pieces, or several at once, would fit in the place of one of its own) is in some best packing and is fixed
for good, as often as its pieces last; passes repeat while they fix anything. Best fit: what is left goes, longest first,
to the fullest sequence that has room. Equal sequences are made together, so there are a few thousand steps at most.

Each step owns an interval of the ranks of each length; a piece finds its sequence from its rank among the pieces of its
length: its number within the part of the table it was written in, plus the pieces of that length in earlier parts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, table
from .stretches import StretchEncoder, byte_level

CAPACITY, END_ID = 1024, 2
#: Counts by part and length are broadcast up to so many rows (of 24 bytes), and joined by a shuffle beyond.
BROADCAST_ROWS = 2_000_000
#: Ids of one Arrow batch are at most so many bytes, or those of one piece.
BATCH_BYTES = 1 << 26
#: A step of the plan: [(length, pieces of it)] of each sequence, and how many sequences.
Step = tuple[list[tuple[int, int]], int]


def _least(counts: list[int], without: int, k: int) -> int | None:
    """The sum of the k smallest lengths that are there, one of `without` being taken; None if there are fewer."""
    total = 0
    for s, n in enumerate(counts):
        n -= s == without
        if n > 0:
            use = min(n, k)
            total, k = total + use * s, k - use
            if not k:
                return total
    return None


def _largest(counts: list[int], most: int, taken: Counter) -> int:
    """The largest length up to most that is there beside those taken; 0 if none."""
    return next((s for s in range(most, 0, -1) if counts[s] > taken[s]), 0)


def _best_pair(counts: list[int], room: int, taken: Counter, above: int = 0) -> int:
    """The largest sum, at most room, of two lengths over `above` that are there beside those taken; 0 if none."""
    best = 0
    for x in range(room, above, -1):
        if counts[x] > taken[x] and x < room:
            taken[x] += 1
            y = _largest(counts, min(x, room - x), taken)
            taken[x] -= 1
            best = max(best, x + y if y > above else 0)
    return best


def dominating(counts: list[int], j: int, capacity: int) -> list[int] | None:
    """Lengths that with j dominate every set with j that fits; None if no such set of up to three is known."""
    room, taken = capacity - j, Counter([j])
    one = _largest(counts, room, taken)
    if not one:
        return []
    two = _least(counts, j, 2)
    if one == room or two is None or two > room:
        return [one]
    three = _least(counts, j, 3)
    if three is not None and three <= room:
        return None
    if _best_pair(counts, room, taken) <= one:
        return [one]
    other = _largest(counts, room - one, taken + Counter([one]))
    # pairs of which both are longer than `other` must fit in the place of `one`
    return [one, other] if other and _best_pair(counts, room, taken, other) <= one else None


def reduce(counts: list[int], capacity: int) -> list[Step]:
    """Fixes dominating sets, taking their pieces out of counts (by length), until a pass fixes none."""
    steps: list[Step] = []
    while True:
        before = len(steps)
        for j in range(capacity, 0, -1):
            while counts[j] and (others := dominating(counts, j, capacity)) is not None:
                use = Counter([j, *others])
                times = min(counts[s] // n for s, n in use.items())
                for s, n in use.items():
                    counts[s] -= n * times
                steps.append((sorted(use.items(), reverse=True), times))
        if len(steps) == before:
            return steps


def best_fit(counts: list[int], capacity: int) -> list[Step]:
    """Longest first, each piece into the fullest sequence with room for it, or into a new one."""
    open_: dict[int, list[Step]] = defaultdict(list)
    for s in range(capacity, 0, -1):
        left = counts[s]
        for room in range(s, capacity):
            # a sequence that just got one is the fullest still, as long as there is room
            most, kept, groups = room // s, [], open_[room] if left else []
            for held, times in groups:
                full = min(times, left // most)
                more = left - full * most if full < times else 0
                if full:
                    open_[room - most * s].append(([*held, (s, most)], full))
                if more:
                    open_[room - more * s].append(([*held, (s, more)], 1))
                left -= full * most + more
                if times - full - bool(more):
                    kept.append((held, times - full - bool(more)))
            if groups:
                open_[room] = kept
        full, more = divmod(left, capacity // s)
        if full:
            open_[capacity % s].append(([(s, capacity // s)], full))
        if more:
            open_[capacity - more * s].append(([(s, more)], 1))
    return [g for room in sorted(open_) for g in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, pieces of it in a sequence, first sequence, offset of the first) of all steps, given
    how many pieces of each length there are."""
    by_length = [counts.get(s, 0) for s in range(capacity + 1)]
    steps = reduce(by_length, capacity) + best_fit(by_length, capacity)
    rows, sequence, rank = [], 0, Counter()
    for held, times in steps:
        offset = 0
        for s, n in held:
            rows.append((s, rank[s], rank[s] + n * times, n, sequence, offset))
            rank[s] += n * times
            offset += s * n
        sequence += times
    return rows


def encode_pieces(docs: DataFrame, encode: Callable[[], StretchEncoder], end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, part, nth): the pieces of every row, ids as little-endian unsigned 32-bit integers.

    part is the task that wrote the piece, nth its number among those of its length there. Null texts are empty and have the
    end id alone; rows with a null or repeated id are rows like others.
    """
    names = ["id", "piece", "start", "length", "ids", "part", "nth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encode(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in sliced(batches, 4096):
            ids, bounds = enc.batch(b.column(1))
            sizes = np.diff(bounds) + 1
            flat = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            n = -(-sizes // capacity)
            of, ends = np.repeat(np.arange(len(sizes)), n), np.cumsum(n)
            piece = np.arange(len(of)) - (ends - n)[of]
            first = (sizes - (n - 1) * capacity)[of]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            # numbers of equal lengths: in order of the rows, from those of earlier batches on
            order = np.argsort(length, kind="stable")
            kinds, at, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(at, many) + seen[length[order]]
            seen[kinds] += many
            columns = [b.column(0).take(pa.array(of)), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()))), None, pa.array(np.full(len(of), part), pa.int32()), pa.array(nth)]
            cuts = np.concatenate([[0], np.cumsum(length)]) * 4
            a = 0
            while a < len(of):
                z = max(a + 1, int(np.searchsorted(cuts, cuts[a] + BATCH_BYTES, "right")) - 1)
                raw = flat[cuts[a] // 4 : cuts[z] // 4]
                columns[4] = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((cuts[a : z + 1] - cuts[a]).astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([c if k == 4 else c.slice(a, z - a) for k, c in enumerate(columns)], names=names)
                a = z

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(pieces, "id long, piece int, start long, length long, ids binary, part int, nth long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table with length, part and nth) with sequence_id and offset in place of part and nth.

    Every piece of 1 to capacity ids gets a place; a sequence's pieces lie one after another from offset 0. The plan is
    broadcast, its size being bounded by the capacity alone.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = spark.createDataFrame(plan(lengths, capacity), "length long, _from long, _to long, _each long, _first long, _offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "part"]).withColumn("_rank", F.col("_start") + F.col("nth"))
    placed = ranked.join(F.broadcast(steps), "length").where("_rank >= _from AND _rank < _to")
    within = F.col("_rank") - F.col("_from")
    return placed.select(
        *[c for c in pieces.columns if c not in ("part", "nth")],
        (F.col("_first") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + within % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): what a trainer reads, the ids of each sequence and the (offset, length, id, piece) in it."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(held.alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("held", lambda x: F.struct(x["offset"], x["length"], x["id"], x["piece"])).alias("pieces"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pieces = materialize(encode_pieces(table(spark, sf_dir, "documents"), lambda: byte_level(path, pattern)), "pieces", compression="zstd")
    out = pack(pieces)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
