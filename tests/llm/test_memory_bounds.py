"""What keeps a task's memory small: batches of bounded bytes, one text's words at a time."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quill.llm.common import BATCH, BATCH_BYTES, bound_batches, byte_setting
from quill.llm.substrings import Split, locate, phrase_hashes


def test_batches_of_long_texts_are_bounded(spark):
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "64m")
        bound_batches(spark)
        assert byte_setting(spark, BATCH) == BATCH_BYTES

        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t"))
        sizes = [r.n for r in texts.mapInArrow(count, "n long").collect()]
        assert sum(sizes) == 3000 and max(sizes) * 4000 < 1.1 * BATCH_BYTES
        spark.conf.set(BATCH, "1m")
        bound_batches(spark)
        assert byte_setting(spark, BATCH) == 1 << 20
    finally:
        spark.conf.set(BATCH, before)


def test_locate_finds_every_occurrence_with_automata_of_any_size():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 2, 3, 40, 200)] + [b"", "é a b".encode()]
    split = list(Split(texts))
    wanted = {int(h) for w in split for h in phrase_hashes(w, 3)[::5]}
    want = [[i for i, h in enumerate(phrase_hashes(w, 3).tolist()) if h in wanted] for w in split]
    for most in (1, 30, 10_000):
        assert [x.tolist() for x in locate(Split(texts), wanted, 3, most)] == want
    assert all(len(x) == 0 for x in locate(Split(texts), set(), 3))
    assert locate(Split([]), wanted, 3) == [] and np.all([isinstance(x, np.ndarray) for x in locate(Split(texts), wanted, 3)])
