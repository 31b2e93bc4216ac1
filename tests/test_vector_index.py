import numpy as np
import pytest

from quill.catalogue import QUERIES
from quill.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<float>"


def made(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))
    return [(i, [float(v) for v in row]) for i, row in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]


def exact(rows, questions, limit):
    out = {}
    for k, q in questions:
        s = [(-round(float(np.dot(np.array(v, np.float64), q)), 6), i) for i, v in rows]
        out[k] = [i for _, i in sorted(s)[:limit]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_and_what_is_exact(spark, tmp_path):
    rows = made(4000)
    rows += [(9000 + i, v) for i, (_, v) in enumerate(rows[:30])]  # copies: ties go by id
    e = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] % 50 == 0]
    q = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    book = vi.fit(e, 16, cells=20, parts=8)
    codes = vi.write_codes(vi.build(e, book), str(tmp_path / "codes"))
    assert codes.count() == len(rows) and max(len(r.code) for r in codes.take(9)) == 8
    want = exact(rows, asked, 10)
    for probes, rerank, least in ((None, len(rows), 1.0), (None, 400, 0.97), (10, 400, 0.9)):
        got = found(vi.search(codes, e, book, q, 10, probes, rerank))
        hits = sum(len(set(got[k]) & set(want[k])) for k in want) / (10 * len(want))
        assert hits >= least, (probes, rerank, hits)
        assert probes or rerank < 4000 or got == want
    r = vi.recall(vi.search(codes, e, book, q, 10, rerank=400), spark.createDataFrame([(k, i) for k, v in want.items() for i in v], "query_id long, vec_id long"))
    assert r.agg({"n_exact": "min"}).first()[0] == 10 and r.agg({"n_found": "avg"}).first()[0] >= 9.5


def test_unusable_vectors_blocks_and_empty_tables(spark, tmp_path):
    bad = [(900, None), (901, [1.0]), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float("inf")] * 16)]
    rows = made(50)
    e = spark.createDataFrame(rows + bad, SCHEMA)
    book = vi.fit(e, 16, cells=64, parts=5)  # more cells than rows; 16 is not a multiple of 5
    codes = vi.build(e, book)
    assert codes.count() == 50
    q = spark.createDataFrame([(1, rows[3][1]), *bad], "query_id long, query_vector array<float>")
    assert found(vi.search(codes, e, book, q, 60)) == exact(rows, [(1, rows[3][1])], 60)
    assert vi.search(codes, e, book, q.limit(0), 5).count() == 0
    assert vi.search(codes.limit(0), e, book, q, 5).count() == 0
    with pytest.raises(ValueError):
        vi.fit(e.limit(0), 16)
    many = spark.range(vi.BLOCK + 1).selectExpr("id AS query_id", "array_repeat(1.0D, 16) AS query_vector")
    with pytest.raises(ValueError):
        vi.search(codes, e, book, many, 5)
    ones = vi.search_blocks(str(tmp_path / "found"), codes, e, book, many, 2)
    assert ones.count() == 2 * (vi.BLOCK + 1) and ones.select("vec_id").distinct().count() == 2
    assert vi.search_blocks(str(tmp_path / "none"), codes, e, book, many.limit(0), 2).count() == 0


def test_recall_over_the_table(spark):
    rows = QUERIES["vector_index_topk"](spark, "/root/testdata/sf0.1").collect()
    per = {r.query_id: (r.n_found, r.n_exact) for r in rows}
    assert len(per) == 40 and sum(a for a, _ in per.values()) >= 0.95 * sum(b for _, b in per.values())
