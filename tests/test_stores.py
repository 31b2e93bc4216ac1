import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import index as ix
from quill.operators import vectors as ve
from quill.operators.contain import containing
from quill.sources import files, pages, state


def test_prefixes_and_changes(spark, tmp_path):
    path = str(tmp_path / "c")
    files.write_pointer(spark, path, "ab" * 9000)
    assert state.prefix_digest(spark, path, 15) == hashlib.sha1(("ab" * 9000)[:15].encode()).hexdigest()
    before = state.file_state(spark, path)
    assert state.change(spark, path, before)[0] == "current" and state.change(spark, path, None)[0] == "rebuild"
    files.write_pointer(spark, path, "ab" * 9000 + '\n{"a":1}\n')
    assert state.change(spark, path, before)[0] == "append"
    assert [r.a for r in state.read_from_offset(spark, path, before["size"] + 1, "a int").collect()] == [1]
    files.write_pointer(spark, path, "xb" * 9100)
    assert state.change(spark, path, before)[0] == "rebuild"
    assert state.change(spark, str(tmp_path / "absent"), before)[0] == "rebuild" and state.file_state(spark, str(tmp_path / "absent"))["size"] is None


def test_a_torn_index_is_not_complete(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "satu dua"), (2, "dua")], "doc_id long, text string")
    ix.write(ix.build(docs), root)
    assert state.complete(spark, root) and [p.name for p in tmp_path.iterdir()] == ["index"]
    (tmp_path / "index" / "terms" / "_SUCCESS").unlink()
    assert not state.complete(spark, root)


def test_versions_switch_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    files.publish_version(spark.range(3), root)
    first = files.read_version(spark, root)
    files.publish_version(spark.range(5), root)
    assert first.count() == 3 and files.read_version(spark, root).count() == 5


def test_rebuild_of_some_files(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "units")
    text = spark.createDataFrame([("a", 1, "Pasal 1\nisi"), ("b", 1, "Pasal 2\nisi"), ("c", 1, None)], "file_id string, n int, t string")
    items = F.array(F.struct(F.lit("isi").alias("text"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("width"), F.lit(4.0).alias("height"), F.lit("f").alias("font_name"), F.lit(9.0).alias("font_size"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("rotation"), F.array().alias("words")))
    pages.write_raw(text.select("file_id", pages.page_row(F.col("n"), F.col("t"), items=items).alias("page")), raw)
    assert pages.read_raw(spark, raw).where("page.text_item_count = 1 AND page.text_items[0].font_size = 9.0").count() == 3
    one = spark.createDataFrame([("b",)], "file_id string")
    assert {r.file_id for r in pages.rebuild_units(spark, raw, root, excluded=one).collect()} == {"a"}
    assert {r.file_id for r in pages.rebuild_units(spark, raw, root, only=one).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        pages.rebuild_units(spark, raw, root, excluded=one, only=one)
    assert {r.file_id for r in files.read_version(spark, root).select("file_id").collect()} == {"a", "b"}


def test_vectors_are_checked(spark, tmp_path):
    root = str(tmp_path / "v")
    rows = spark.createDataFrame([(k, "x" * k) for k in range(1, 6)] + [(9, None)], "vec_id long, text string")
    coded = ve.encode(rows, lambda ts: np.array([[len(t), 1.0] for t in ts]), batch=2)
    assert ve.write_vectors(coded, root, {"model": "n"})["dimension"] == 2
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [r.vec_id for r in ve.search(spark, root, q, 2, settings={"model": "n"}).orderBy("rank").collect()] == [5, 4]
    assert [r.vec_id for r in ve.search(spark, root, q, 9, filters={"text": "xx"}).collect()] == [2]
    with pytest.raises(ValueError):
        ve.read_vectors(spark, root, {"model": "m"})
    with pytest.raises(ValueError):
        ve.search(spark, root, spark.createDataFrame([(0, [1.0])], q.schema), 2)


def test_containing_is_what_contains_says(spark):
    import random

    rng = random.Random(5)
    words = ["a", "bb", "c-c", "d/e.f", "Gg", "h,", "ï", "1.2"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(150)] + [(200, None), (201, "")]
    needles = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 8)))[rng.randrange(2) :]) for i in range(60)] + [(100, None), (101, ""), (102, "zz")]
    for fold in (False, True):
        want = sorted((n, d) for n, x in needles for d, t in texts if x is not None and t is not None and (x.lower() in t.lower() if fold else x in t))
        got = containing(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(needles, "n int, needle string"), "doc_id", "n", fold_case=fold)
        assert sorted((r.n, r.doc_id) for r in got.collect()) == want and len(want) > 200
