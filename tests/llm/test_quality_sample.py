"""The classifier learns from whole texts of the sampled documents."""

import zlib

import numpy as np

from quill.llm import quality


def test_lines_after_the_200th_count(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda rows: sorted(len(f) for _, f in rows))
    docs = spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(n))) for i, n in ((1, 3), (2, 200), (3, 406), (4, 5))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, quality int")
    held_in = [r.doc_id for r in labels.where(quality.fold("doc_id", 5) != 0).collect()]
    assert 3 in held_in
    assert quality.train(docs, labels) == sorted({1: 3, 2: 200, 3: 406}[i] for i in held_in)


def test_very_long_and_repeated_documents_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda rows: sorted((y, len(f)) for y, f in rows))
    held_in = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:3]
    texts = {held_in[0]: "line\n" * 20_000, held_in[1]: "a\nb", held_in[2]: None}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items() for _ in range(30)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in held_in], "doc_id long, quality int")
    assert quality.train(docs, labels) == [(1, 2), (1, quality.PIECE * quality.PIECES)]
    whole = np.arange(20_000)[:, None]
    got = quality.drawn(whole)[:, 0]
    assert len(set(got.tolist())) == len(got) and (np.diff(got) > 0).all() and got[-1] > 15_000
