"""Embedding near-dedup (9): a subspace pigeonhole join.

Unit vectors link at cosine c or more when their squared distance is at most 2 - 2c. A fixed rotation spreads the
variance over all axes; the rotated vector is split into blocks, and as the blocks' squared distances add up to the
whole, every linked pair is within its share of the budget, (block's axes / all axes) x (2 - 2c), in at least one block.
So each block is range-joined by itself: rows go to cells of the block's first axes, as wide as the share's root, and
each cell meets itself and half of its neighbours. A pair in range is taken up only by the first block that it is in
range in, and verified by its cosine in double precision, so nothing is counted twice and nothing is lost.

Equal vectors of one label are one class and are never paired; a cell over a limit is dealt out in parts. Tasks return
counts of links and spanning forests, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, materialize, table

BLOCKS, CELL_AXES, TILE = 4, 2, 512
#: Rows of the table of large cells (five numbers each) up to which it is broadcast.
BROADCAST_CELLS = 100_000


def rotation(dims: int, seed: int = 9) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def spans(dims: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """The axes of each block, as even as can be; fewer blocks than asked if there are fewer axes."""
    at = np.linspace(0, dims, min(blocks, dims) + 1).astype(int).tolist()
    return list(zip(at, at[1:], strict=False))


def _neighbours(axes: int) -> list[tuple[int, ...]]:
    """Offsets of a cell's neighbours, one of each opposite two, and its own."""
    return [o for o in product((-1, 0, 1), repeat=axes) if o >= (0,) * axes]


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells(batches: Iterator[pa.RecordBatch], cosine: float, blocks: int, axes: int, kind: str | None) -> Iterator[pa.RecordBatch]:
    """kind: type of the components that go along ("<f4" or "<f8"), or None for places alone. For each class: a row in its own cell (home) and one in half of its neighbours, so that a cell's homes meet what comes to it."""
    slack = 1e-6
    for b in batches:
        ids, labels, copies = (np.asarray(b.column(k)) for k in range(3))
        vectors = b.column(3).to_pylist()
        by_dims: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_dims.setdefault(len(v), []).append(k)
        for dims, at in by_dims.items():
            raw = np.array([vectors[k] for k in at], kind or "<f8")
            turned = units(raw) @ rotation(dims)
            packed = [v.tobytes() if kind else None for v in raw]
            for block, (lo, hi) in enumerate(spans(dims, blocks)):
                used = min(axes, hi - lo)
                width = np.sqrt((2 - 2 * cosine) * (hi - lo) / dims) + slack
                cell = np.floor(turned[:, lo : lo + used] / width).astype(np.int64)
                for offset in _neighbours(used):
                    to = cell - np.array(offset)
                    name = to[:, 0] * (1 << 20) + to[:, 1] if used > 1 else to[:, 0]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(labels[at]), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(name), pa.array(np.full(n, not any(offset))), pa.array(ids[at]), pa.array(copies[at]), pa.array(packed, pa.binary())],
                        names=["label", "dims", "block", "cell", "home", "id", "copies", "v"],
                    )


def join_cell(block: int, dims: int, blocks: int, cosine: float, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (positions in a, positions in b) of the pairs that `block` is the first to have in range. same: b is a, each pair once."""
    turn, parts, budget = rotation(dims), spans(dims, blocks), 2 - 2 * cosine
    an, bn = units(a), units(b)
    at, bt = an @ turn, bn @ turn
    left, right = [], []
    lo, hi = parts[block]
    share = budget * (hi - lo) / dims + 1e-9
    squares = (bt[:, lo:hi] ** 2).sum(1)
    for s in range(0, len(a), TILE):
        x = at[s : s + TILE, lo:hi]
        near = (x**2).sum(1)[:, None] + squares[None, :] - 2 * (x @ bt[:, lo:hi].T) <= share
        i, j = np.nonzero(near)
        if same:
            i, j = i[j > i + s], j[j > i + s]
        for first, last in parts[:block]:
            d = ((at[s + i, first:last] - bt[j, first:last]) ** 2).sum(1)
            new = d > budget * (last - first) / dims + 1e-9
            i, j = i[new], j[new]
        ok = (an[s + i] * bn[j]).sum(1) >= cosine
        left.append(s + i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def join_group(group: pa.Table, block: int, dims: int, blocks: int, cosine: float, kind: str) -> pa.RecordBatch | None:
    """Links of one part of a cell: among its own homes, with the homes of other parts (from the side of the smaller id), with visitors."""
    home, mine, ids, copies = (np.asarray(group.column(k)) for k in range(5, 9))
    v = np.frombuffer(b"".join(group.column(9).to_pylist()), kind).reshape(-1, dims)
    own, others, visitors = np.nonzero(home & mine)[0], np.nonzero(home & ~mine)[0], np.nonzero(~home)[0]
    if not len(own):
        return None
    total, forest = np.zeros(len(ids)), Forest()
    for there, same in ((own, True), (others, False), (visitors, False)):
        if len(there) < 1 + same:
            continue
        i, j = join_cell(block, dims, blocks, cosine, v[own], v[there], same)
        i, j = own[i], there[j]
        if there is others:
            i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        for x, y in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
            forest.join(x, y)
    some = np.nonzero(total)[0]
    if not len(some):
        return None
    a = [*ids[some].tolist(), *(x for x, _ in forest.kept)]
    b = [*total[some].astype(np.int64).tolist(), *(y for _, y in forest.kept)]
    return pa.RecordBatch.from_arrays([pa.array([False] * len(some) + [True] * len(forest.kept)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["edge", "a", "b"])


def join_cells(batches: Iterator[pa.RecordBatch], cosine: float, blocks: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and part: joins each part as soon as it is complete. Returns counts of links (a: id) and edges."""

    def groups() -> Iterator[pa.Table]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            new = np.nonzero(np.any([np.diff(np.asarray(t.column(k))) != 0 for k in range(5)], axis=0))[0] + 1
            at = [0, *new.tolist()]
            for s, e in zip(at, at[1:], strict=False):
                yield t.slice(s, e - s)
            held = t.slice(at[-1])
        if held is not None:
            yield held

    for g in groups():
        if g.num_rows > 1 and (out := join_group(g, g.column(2)[0].as_py(), g.column(1)[0].as_py(), blocks, cosine, kind)):
            yield out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.93, blocks: int = BLOCKS, axes: int = CELL_AXES, limit: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of df.

    Vectors link within one label (all are of one if label_col is None) and one length. Vectors that are null, empty,
    zero or hold null, NaN or infinite components, and rows with a null label, link with nothing; they and all unlinked
    rows are their own component. Rows are told apart by their ids; rows with a null id are given no links.
    """
    if not 0 < cosine < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    label = F.lit(0) if label_col is None else F.col(label_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = materialize(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    named = "label long, dims int, block int, cell long, home boolean, id long, copies long, v binary"
    key = ["label", "dims", "block", "cell"]

    def dealt(with_vectors: bool) -> DataFrame:
        return classes.select("id", "label", "copies", "v").mapInArrow(lambda batches: cells(batches, cosine, blocks, axes, kind if with_vectors else None), named)

    # cells over the limit are dealt out in parts: a part has its own share of the homes, and everything in the cell comes to each part
    large = materialize(dealt(False).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "large")
    few = large.count() <= BROADCAST_CELLS
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(limit)).cast("int")
    whole = dealt(True).join(F.broadcast(large) if few else large, key, "left")
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("mine", F.pmod(F.xxhash64("id"), parts) == F.col("part"))
    key = [*key, "part"]
    order = [*key, "home", "mine", "id", "copies", "v"]
    found = materialize(
        whole.select(*order).repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: join_cells(batches, cosine, blocks, kind), "edge boolean, a long, b long"), "found"
    )
    counts = found.where("NOT edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    roots = components(found.where("edge"))
    # the root of components() is the smallest id of classes, which stand for their smallest row
    named = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "named")
    linked = good.join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP9_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT reach.n, p.y FROM reach JOIN p ON reach.m = p.x),
c AS (SELECT n AS vec_id, min(m) AS component_id FROM reach GROUP BY n), k AS (SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
