import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quill.sources import ranges as rg


def body(seed=2, n=60):
    rng = random.Random(seed)
    return "".join(json.dumps({"a": i, "b": "é" * rng.randrange(30)}, ensure_ascii=False) + rng.choice(["\n", "\r\n", "\n\n"]) for i in range(n)).encode()


def table(spark, *rows):
    return spark.createDataFrame(rows, "name string, path string, length long")


def plain_lines(data):
    out, at = [], 0
    for raw in data.split(b"\n"):
        if raw.strip():
            out.append((at, raw.strip().decode("utf-8", "replace")))
        at += len(raw) + 1
    return out


def test_every_cut_gives_every_line_once(tmp_path, monkeypatch):
    data = body() + b'{"a": 99}'  # no line end at the end
    path = tmp_path / "f"
    path.write_bytes(data)
    want = plain_lines(data)
    for read in (5, 64, 1 << 20):
        monkeypatch.setattr(rg, "READ", read)
        for splits in range(1, 8):
            size = -(-len(data) // splits)
            got = [x for a in range(0, len(data), size) for x in rg.lines_between(str(path), a, min(a + size, len(data)))]
            assert got == want
    for cut in range(len(data) + 1):
        got = [*rg.lines_between(str(path), 0, cut), *rg.lines_between(str(path), cut, len(data))]
        assert [x for x in got] == want, cut


def test_offsets_rejects_and_empty_files(spark, tmp_path):
    old, new = body(), b'{"a": 1000, "b": "x"}\n{"a": \n[1]\n{"a": "text"}\nnull\n{"b": "only"}\n'
    (tmp_path / "a b+c%20é#").write_bytes(old + new)
    (tmp_path / "empty").write_bytes(b"")
    found = rg.listed(spark, str(tmp_path)).withColumn("name", F.lit("f")).select("name", "path", "length")
    assert [r.length for r in found.collect()] == [len(old + new)]
    files = found.unionByName(table(spark, ("empty", str(tmp_path / "empty"), 0)))
    for size in (7, 50, 1 << 20):
        good, bad = rg.records(rg.lines(rg.pieces(files.withColumn("start", F.lit(len(old))), size)), "a int, b string")
        assert sorted((r.a or 0, r.b) for r in good.collect()) == [(0, "only"), (1000, "x")]
        assert sorted(r.line for r in bad.collect()) == sorted(['{"a":', "[1]", '{"a": "text"}', "null"])
    assert sorted((r.offset, r.line) for r in rg.lines(rg.pieces(files, 100)).collect()) == plain_lines(old + new)


def test_source_in_batches_and_as_a_stream(spark, tmp_path):
    rg.register(spark)
    data = body()
    path, out, seen = tmp_path / "f", str(tmp_path / "out"), str(tmp_path / "seen")
    path.write_bytes(data)
    for start in (0, data.index(b"\n", 500) + 1):
        got = spark.read.format("line_ranges").option("path", str(path)).option("piece", 200).option("start", start).load()
        assert sorted(map(tuple, got.collect())) == [x for x in plain_lines(data) if x[0] >= start]
    ends = [data.index(b"\n", 300) + 5, len(data) - 20, len(data) - 20, len(data)]  # two of them within a line
    for end in ends:
        path.write_bytes(data[:end])
        stream = spark.readStream.format("line_ranges").option("path", str(path)).option("piece", 150).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).start()
        try:
            query.processAllAvailable()  # stopped, and started again where it was
        finally:
            query.stop()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == plain_lines(data)


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_first_changed_piece(spark, tmp_path, fan):
    rng = random.Random(fan)
    was, rows, later, want = [], [], [], {}
    for k in range(6):
        data = bytearray(rng.randbytes(rng.choice([1, 99, 100, 1001, 2500])))
        other = bytearray(data)
        at = rng.randrange(len(data)) if k % 2 else None
        if at is not None:
            other[at] ^= 1
        other += rng.randbytes(rng.choice([0, 150]))
        for tag, x, to in (("a", data, rows), ("b", other, later)):
            (tmp_path / f"{tag}{k}").write_bytes(x)
            to.append((str(k), str(tmp_path / f"{tag}{k}"), len(data)))
        want[str(k)] = None if at is None else at // 100
        was.append((str(k), len(data), len(other)))
    for tag, files in (("before", rows), ("after", later)):
        rg.tree(rg.pieces(table(spark, *files), 100), str(tmp_path / tag), fan)
    before, after = (rg.read_tree(spark, str(tmp_path / t)) for t in ("before", "after"))
    assert {r.name: r.number for r in rg.first_changed(before, after, fan).collect()} == want
    leaf = before.where("level = 0 AND name = '0' AND number = 0").first().sha256
    assert leaf == hashlib.sha256((tmp_path / "a0").read_bytes()[:100]).hexdigest()
    if fan == 1024:
        now = table(spark, *[(n, str(tmp_path / f"b{n}"), long) for n, _, long in was if n != "4"], ("new", str(tmp_path / "b4"), 1))
        got = {r.name: (r.verdict, r.number) for r in rg.verdicts(table(spark, *rows), before, now, 100).collect()}
        expect = {n: ("rebuild", want[n]) if want[n] is not None else ("append", None) if long > short else ("current", None) for n, short, long in was}
        assert got == expect | {"4": ("rebuild", None), "new": ("append", None)}


def test_trees_of_nothing(spark, tmp_path):
    files = table(spark, ("f", "/absent", 0))
    assert rg.tree(rg.pieces(files), str(tmp_path / "t")).count() == 0
    got = rg.verdicts(files, rg.read_tree(spark, str(tmp_path / "t")), files)
    assert [tuple(r) for r in got.collect()] == [("f", "current", None)]
