"""Joins in time: the last row before each moment, and all rows within a span around it.

Rows of one key are ordered by time in one window, so a key with very many rows would be one task's work. Keys with over
`most` rows, of which there can be few, are therefore cut into pieces at quantiles of their times; each piece is a window of
its own, and what an earlier piece ends with is carried into the next from one small table, a row a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that are ordered in one task.
ROWS = 1_000_000


def as_number(df: DataFrame, c: str) -> Column:
    """A time or number as one that can be cut: times in microseconds, dates in days."""
    kind = dict(df.dtypes)[c]
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)")
    return F.unix_date(c).cast("long") if kind == "date" else F.col(c)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, name: str = "match", tolerance: int | float | None = None, most: int = ROWS) -> DataFrame:
    """left with one more column, `name`: the row of right (as a struct, without the columns of by) that has the same keys
    and the latest time that isn't after left's; null if there is none, or if it is over `tolerance` earlier (in
    microseconds for times, days for dates). Of right rows at one time the greatest by their other columns counts. Null keys
    and times match nothing; every left row stays, repeated rows too. Columns of both sides may have the same names.

    One shuffle of both sides, by key and piece; each row is in one window.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    values = [c for c in right.columns if c not in by]
    held = F.struct(*values)
    right_kind = right.select(held.alias("r")).schema["r"].dataType
    left_rows = left.select(*own, as_number(left, left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right_kind).alias("_right"))
    right_rows = right.where(F.col(right_time).isNotNull()).dropna(subset=list(by)).select(*own, as_number(right, right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left_rows.schema["_left"].dataType).alias("_left"), held.alias("_right"))
    both = right_rows.unionByName(left_rows)
    order = ["_t", "_side", "_right"]
    cuts = _cuts(both, keys, most)
    if cuts is None:
        last = F.last("_right", True).over(Window.partitionBy(*keys).orderBy(*order))
    else:
        pieces = both.join(F.broadcast(cuts), keys, "left").withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col("_t"))), F.lit(0)))
        ends = pieces.where("_side = 0 AND _cuts IS NOT NULL").groupBy(*keys, "_piece").agg(F.max(F.struct("_t", "_right")).alias("_end"))
        every = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_piece")).join(ends, [*keys, "_piece"], "left")
        earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*keys, "_piece", F.last("_end", True).over(earlier)["_right"].alias("_carried"))
        both = pieces.drop("_cuts").join(F.broadcast(carried), [*keys, "_piece"], "left")  # a row for each `most` rows or so
        last = F.coalesce(F.last("_right", True).over(Window.partitionBy(*keys, "_piece").orderBy(*order)), F.col("_carried"))
    out = both.withColumn("_match", last).where("_side = 1")
    if tolerance is not None:
        out = out.withColumn("_then", F.col("_match")[right_time])
        out = out.withColumn("_match", F.when(F.col("_t") - as_number(out, "_then") <= tolerance, F.col("_match")))
    return out.select("_left.*", F.col("_match").alias(name))


def _cuts(both: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """(keys, _cuts) of the keys with over `most` rows: the times at which they are cut. None if there is no such key."""
    large = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    found = large.dropna(subset=keys).collect()  # one row at most for each `most` rows
    if not found:
        return None
    large = both.sparkSession.createDataFrame(found, large.schema)
    rows = both.join(F.broadcast(large), keys)
    # a key's pieces are counted by the largest key's number, so that one call serves all; equal cuts are one
    pieces = max(2, -(-max(r["_n"] for r in found) // most))
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cut = rows.groupBy(*keys).agg(F.percentile_approx("_t", shares, F.lit(max(10_000, 10 * pieces))).alias("_cuts"))
    return cut.select(*keys, F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))


def within(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, before: int | float, after: int | float, name: str = "match") -> DataFrame:
    """left with each row of right of the same keys whose time is from `before` earlier to `after` later, ends included; a
    left row without one is left out. Null keys and times match nothing.

    Time is cut into buckets as wide as the span: right rows are in one, left rows look at the two or three that their span
    touches. So the join is by equality, and a key with very many rows is dealt out by time.
    """
    width = before + after or 1
    keys = [f"_k{i}" for i in range(len(by))]
    values = [c for c in right.columns if c not in by]
    r = right.where(F.col(right_time).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], as_number(right, right_time).alias("_rt"), F.struct(*values).alias(name))
    r = r.withColumn("_bucket", F.floor(F.col("_rt") / width))
    t = as_number(left, left_time)
    asked = left.where(F.col(left_time).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], t.alias("_t"), F.struct(*left.columns).alias("_left"), F.explode(F.sequence(F.floor((t - before) / width), F.floor((t + after) / width))).alias("_bucket"))
    met = asked.join(r, [*keys, "_bucket"]).where((F.col("_rt") >= F.col("_t") - before) & (F.col("_rt") <= F.col("_t") + after))
    return met.select("_left.*", name)
