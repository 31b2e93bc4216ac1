"""Which texts contain which needles, without comparing each with each: both meet by a word run of the needle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import side

WORD = r"[\p{L}\p{N}]+"
#: Words in the run by which a text and a needle meet; needles with fewer inner words meet by one.
RUN = 5


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def _runs(w: Column, n: int) -> Column:
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n))))


def containing(texts: DataFrame, needles: DataFrame, key: str, needle_key: str, text: str = "text", needle: str = "needle", fold_case: bool = False) -> DataFrame:
    """(needle_key, key, columns of needles) of the pairs where the text contains the needle as it stands.

    The words inside a needle, all but its first and last, are whole words of every text that contains it. A run of them
    in the middle is hashed; texts stream their runs past those hashes, and what meets is compared as strings. A needle
    of less than three words has no inner word and meets by containment alone: those are counted to be few. An empty
    needle is in every text, a null one in none.
    """
    inner = F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))
    named = needles.withColumn("_w", words(F.col(needle))).withColumn("_in", inner).where(F.col(needle).isNotNull())
    size = F.when(F.size("_in") >= RUN, RUN).otherwise(1)
    keyed = named.where(F.size("_in") > 0).withColumn("_n", size).withColumn("_h", F.xxhash64(F.slice("_in", F.floor((F.size("_in") - F.col("_n")) / 2).cast("int") + 1, F.col("_n"))))
    w = texts.withColumn("_t", words(F.col(text)))
    runs = [w.select(key, F.lit(n).alias("_n"), F.explode(_runs(F.col("_t"), n)).alias("_h")) for n in (RUN, 1)]
    met = runs[0].unionByName(runs[1]).join(side(keyed.select(needle_key, "_n", "_h")), ["_n", "_h"]).select(needle_key, key).distinct()
    a, b = F.col("_text"), F.col("_needle")
    hit = F.contains(F.lower(a), F.lower(b)) if fold_case else F.contains(a, b)
    read = texts.select(key, F.col(text).alias("_text"))
    asked = needles.withColumn("_needle", F.col(needle))
    found = met.join(side(asked), needle_key).join(read, key).where(hit)
    short = asked.join(named.where(F.size("_in") == 0).select(needle_key), needle_key, "left_semi")
    if short.limit(1).count():
        found = found.unionByName(read.join(side(short), hit))
    return found.select(*needles.columns, key)
