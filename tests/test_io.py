import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quill.operators import lexicon as lx
from quill.operators import search as se
from quill.sources import files
from quill.streaming import events, ingest


def test_json_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "records.ndjson").write_text('{"title":"x","files":[{"kind":"k1","saved_path":"p1"},{"saved_path":"p2"}]}\n\n{"title":"y"}\n')
    (tmp_path / "b" / "one.json").write_text(json.dumps({"title": "z", "tab_name": "tab", "file": {"saved_path": "p3"}}))
    records = files.read_records(spark, str(tmp_path), ["a", "b", "none"])
    assert sorted(r.source for r in records.collect()) == ["a", "a", "b"]
    entries = {(r.saved_path, r.kind) for r in files.file_entries(records).collect()}
    assert entries == {("p1", "k1"), ("p2", None), ("p3", "tab")}
    assert files.read_ndjson(spark, str(tmp_path / "absent"), "a int", missing_ok=True).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        files.read_ndjson(spark, str(tmp_path / "absent"), "a int").count()
    listed = files.list_files(spark, str(tmp_path), digests=True).collect()
    assert {r.basename for r in listed} == {"records.ndjson", "one.json"} and all(len(r.sha256) == 64 for r in listed)


def test_publish_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    files.publish(spark.range(3), path)
    files.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_feedback(spark, tmp_path):
    rows = spark.createDataFrame([("r1", True, None), ("r2", False, "no")], "request_id string, helpful boolean, comment string")
    files.append_feedback(spark, rows, str(tmp_path / "f"))
    files.append_feedback(spark, rows, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).select("id").distinct().count() == 4
    with pytest.raises(Exception):  # noqa: B017
        files.append_feedback(spark, spark.createDataFrame([("", True, None)], rows.schema), str(tmp_path / "f"))


def test_stream_windows_match_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    rows.append((999, start + dt.timedelta(days=2), 0, "view", 1.0))  # moves the watermark on
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.where("event_id < 999").write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), df.schema)
    q = events.append(events.windowed(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    df.where("event_id = 999").write.mode("append").parquet(str(tmp_path / "in"))
    q = events.append(events.windowed(events.read(spark, str(tmp_path / "in"), df.schema), "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    q = events.append(events.windowed(events.read(spark, str(tmp_path / "in"), df.schema), "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.window_start, r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.window_start, r.event_type, r.n, r.total) for r in events.windowed(df.where("event_id < 999"), "1 hour").collect())
    assert got == want and got


def test_streamed_index_is_the_batch_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"kata {i % 5} umum kata{i % 3}") for i in range(40)], "doc_id long, text string")
    root, sign = str(tmp_path / "ix"), ingest.signature({"text": 1})
    for part in (0, 1):
        docs.where(f"doc_id % 2 = {part}").write.mode("append").parquet(str(tmp_path / "docs"))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
        ingest.follow(stream, root, str(tmp_path / "cp"), sign).awaitTermination()
    streamed = ingest.load(spark, root)
    from quill.operators import index as ix

    whole = ix.build(docs)
    for a, b in ((streamed.terms, whole.terms), (streamed.postings, whole.postings)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert abs(streamed.stats.first()["avg_len"] - whole.stats.first()["avg_len"]) < 1e-9
    searches = spark.createDataFrame([(1, "kata1 umum"), (2, "kata2")], "search_id long, query string")
    assert sorted(map(str, se.bm25(streamed, searches).select("search_id", "doc_id", F.round("bm25", 6)).collect())) == sorted(map(str, se.bm25(whole, searches).select("search_id", "doc_id", F.round("bm25", 6)).collect()))
    ingest.add(spark, root, docs, "batch-00000000", sign)  # a repeated batch changes nothing
    assert ingest.load(spark, root).docs.count() == 40 and ingest.unseen(docs, streamed).count() == 0
    with pytest.raises(ValueError):
        ingest.add(spark, root, docs, "x", "other")


def test_lexicon_aliases(spark):
    base = spark.createDataFrame([("topics", "a", ["x"]), ("topics", "b", ["y"])], "section string, name string, patterns array<string>")
    ok = spark.createDataFrame([("topics", "a", ["x", "z"], True), ("topics", "b", ["w"], False)], "section string, name string, patterns array<string>, approved boolean")
    assert sorted((r.name, r.patterns) for r in lx.add_aliases(base, ok).collect()) == [("a", ["x", "z"]), ("b", ["y"])]
    bad = spark.createDataFrame([("topics", "none", ["x"], True)], ok.schema)
    with pytest.raises(Exception):  # noqa: B017
        lx.add_aliases(base, bad).collect()
