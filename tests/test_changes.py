import random

import pytest
from pyspark.sql import functions as F

from quill.operators import index as ix
from quill.operators import search as se
from quill.streaming import changes as ch

SCHEMA = "doc_id long, text string, lang string"
WORDS = [f"kata{i}" for i in range(25)]


def rows_of(index):
    return {
        "docs": sorted((r.doc_id, r.text, r.lang, r.doc_len) for r in index.docs.collect()), "postings": sorted((r.term, r.doc_id, r.tf) for r in index.postings.collect()),
        "terms": sorted((r.term, r.df) for r in index.terms.collect()), "stats": [(r.n_docs, round(r.avg_len, 9)) for r in index.stats.collect()],
    }


def test_ten_changes_equal_a_rebuild(spark, tmp_path):
    rng, root, there = random.Random(3), str(tmp_path / "index"), {}
    for number in range(10):
        new = [(rng.randrange(30), " ".join(rng.choices(WORDS, k=rng.randrange(6))) or None, rng.choice(["id", None])) for _ in range(8)]
        away = [(rng.randrange(30),) for _ in range(4)] + [(None,), (999,)]
        for (i,) in away:
            there.pop(i, None)
        best = {}
        for i, text, lang in new:  # the greatest row of an id, null before any text
            best[i] = max(best.get(i, (("",) * 4)), ((text is not None), text or "", (lang is not None), lang or ""), key=lambda x: (bool(x[0]), x[1], bool(x[2]), x[3]))
        there |= {i: (b[1] if b[0] else None, b[3] if b[2] else None) for i, b in best.items()}
        ch.change(spark, root, number, "s", spark.createDataFrame(new, SCHEMA), spark.createDataFrame(away, "doc_id long"), buckets=2)
        assert len(ch.current(spark, root)["runs"]) == bin(number + 1).count("1")
    whole = ix.build(spark.createDataFrame([(i, *v) for i, v in there.items()], SCHEMA))
    assert rows_of(ch.load(spark, root)) == rows_of(whole)
    q = spark.createDataFrame([(1, "kata1 kata2 kata3"), (2, "kata9")], "search_id long, query string")
    found = [sorted((r.search_id, r.doc_id, round(r.bm25, 9)) for r in se.bm25(x, q).collect()) for x in (ch.load(spark, root), whole)]
    assert found[0] == found[1] and found[0]
    before = rows_of(ch.load(spark, root))
    ch.change(spark, root, 9, "s", spark.createDataFrame([(1, "lain", "x")], SCHEMA))  # run again: nothing happens
    assert ch.vacuum(spark, root) and not ch.vacuum(spark, root) and rows_of(ch.load(spark, root)) == before
    with pytest.raises(ValueError):
        ch.change(spark, root, 10, "other", spark.createDataFrame([(1, "lain", "x")], SCHEMA))


def test_levels_carry():
    for fan in (2, 3, 4):
        levels = []
        for n in range(1, 200):
            levels.append(0)
            taken, level = ch.due(levels, fan)
            levels = levels[:-taken] + [level]
            digits, m = 0, n
            while m:
                digits, m = digits + m % fan, m // fan
            assert len(levels) == digits and levels == sorted(levels, reverse=True)


def test_all_deleted_empty_changes_and_null_ids(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        ch.load(spark, root)
    some = spark.createDataFrame([(1, "satu dua", "id"), (2, "dua", None)], SCHEMA)
    ch.change(spark, root, 0, "s", some, buckets=2)
    ch.change(spark, root, 1, "s", deletes=some.select("doc_id"), fan=9)
    gone = ch.load(spark, root)
    assert gone.docs.count() == gone.postings.count() == gone.terms.count() == 0 and gone.stats.first().n_docs == 0 and gone.stats.first().avg_len is None
    ch.change(spark, root, 2, "s", some.limit(0), fan=9)
    ch.change(spark, root, 3, "s", some.where("doc_id = 2"), fan=9)
    assert [(r.term, r.df) for r in ch.load(spark, root).terms.collect()] == [("dua", 1)]
    with pytest.raises(Exception, match="without an id"):
        ch.change(spark, root, 4, "s", spark.createDataFrame([(None, "x", "y")], SCHEMA))
    assert ch.current(spark, root)["last"] == 3 and ch.load(spark, root).docs.count() == 1


def test_stream_of_changes(spark, tmp_path):
    root, source, seen = str(tmp_path / "index"), str(tmp_path / "in"), str(tmp_path / "seen")
    fields = f"{SCHEMA}, deleted boolean"
    for rows in ([(1, "satu", "id", None), (2, "dua tiga", "id", False)], [(1, None, None, True), (2, "empat", "id", False), (3, "lima", "id", None)]):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # stopped and started again
            ch.follow(spark.readStream.schema(fields).parquet(source), root, seen, "s", buckets=2).awaitTermination()
    got = ch.load(spark, root)
    assert sorted((r.term, r.doc_id) for r in got.postings.collect()) == [("empat", 2), ("lima", 3)]
    assert got.docs.agg(F.sum("doc_len")).first()[0] == 2 and got.stats.first().avg_len == 1.0


def test_texts_are_split_and_written_once(spark, tmp_path, monkeypatch):
    root, split = tmp_path / "index", []

    def counted(*args):
        split.append(args)
        return weighted(*args)

    weighted = ix.weighted_tokens
    for module in (ix, ch):
        monkeypatch.setattr(module, "weighted_tokens", counted)
    ch.change(spark, str(root), 0, "s", spark.createDataFrame([(1, "dua satu dua", "id"), (2, None, "x"), (1, "dua", None)], SCHEMA), buckets=2)
    (run,) = root.glob("run-*")
    assert len(split) == 1 and {p.name for p in run.iterdir()} == {"docs", "postings", "gone", "terms"}
    got = ch.load(spark, str(root))
    assert sorted((r.term, r.doc_id, r.tf) for r in got.postings.collect()) == [("dua", 1, 2), ("satu", 1, 1)]
    assert got.docs.columns == ["doc_id", "text", "lang", "doc_len"]
