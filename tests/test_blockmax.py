import random

import numpy as np
import pytest

from quill.operators import blockmax, index, search


def test_seven_bits_round_trip():
    rng = random.Random(1)
    values = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**62, *(rng.getrandbits(rng.randrange(1, 63)) for _ in range(3000))], np.int64)
    raw, size = blockmax.seven_bits(values)
    assert blockmax.unpacked(raw.tobytes()).tolist() == values.tolist()
    assert size[:7].tolist() == [1, 1, 1, 2, 2, 3, 9] and size.sum() == len(raw)
    assert len(blockmax.unpacked(b"")) == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i * 3 + 10**10, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 40, 200])))) for i in range(900)] + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").fillna("", ["text"])
    questions = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(40)] + [(100, "w1 w1 w2 w3"), (101, "unknown words"), (102, "")]
    ix = index.build(docs, keep=True)
    made = {}
    for size in (1 << 17, 100):
        path = str(tmp_path_factory.mktemp("packed") / "p")
        blockmax.pack(ix, block=16, docs=size).write.parquet(path)
        made[size] = spark.read.parquet(path)
    yield ix, spark.createDataFrame(questions, "search_id long, query string"), made
    ix.close()


@pytest.mark.parametrize("docs", [1 << 17, 100])
@pytest.mark.parametrize(("limit", "min_match"), [(1, True), (10, True), (10, False), (2000, False)])
def test_the_rows_are_those_of_the_full_search(corpus, docs, limit, min_match):
    ix, questions, made = corpus
    plain = search.bm25(ix, questions, min_match=min_match, limit=limit)
    pruned = blockmax.pruned_top(made[docs], ix, questions, limit, min_match=min_match, docs=docs)
    want, got = [{(r["search_id"], r["rank"], r["doc_id"]): r["bm25"] for r in x.collect()} for x in (plain, pruned)]
    assert want.keys() == got.keys() and want
    assert all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_batches_of_searches(corpus, monkeypatch):
    ix, questions, made = corpus
    want = blockmax.pruned_top(made[100], ix, questions, 5, docs=100).collect()
    monkeypatch.setattr(blockmax, "SEARCHES", 7)
    assert sorted(blockmax.pruned_top(made[100], ix, questions, 5, docs=100).collect()) == sorted(want)


def test_blocks_are_whole_and_bounded(corpus):
    ix, _, made = corpus
    for rows in made.values():
        assert rows.agg({"n": "max"}).first()[0] == 16
        assert rows.agg({"n": "sum"}).first()[0] == ix.postings.count()
        assert rows.where("first > last").count() == 0


def test_blocks_are_skipped(spark):
    """Of the common words only the blocks are unpacked in which documents with the rare ones lie."""
    rng = random.Random(3)
    rows = [(i, " ".join([f"c{k}" for k in range(10) for _ in range(rng.randrange(3))] + [f"r{k}" for k in range(6) if rng.random() < 0.01])) for i in range(3000)]
    ix = index.build(spark.createDataFrame(rows, "doc_id long, text string"))
    questions = spark.createDataFrame([(1, " ".join([f"r{k}" for k in range(6)] + [f"c{k}" for k in range(10)]))], "search_id long, query string")
    packed = blockmax.pack(ix, block=16)
    use = blockmax.block_use(packed, ix, questions, 5).first()
    assert 0 < use["used"] < 0.5 * use["blocks"]
    want = search.bm25(ix, questions, limit=5).select("doc_id", "rank").collect()
    assert sorted(want) == sorted(blockmax.pruned_top(packed, ix, questions, 5).select("doc_id", "rank").collect())


def test_an_empty_index(spark):
    ix = index.build(spark.createDataFrame([], "doc_id long, text string"))
    questions = spark.createDataFrame([(1, "w1")], "search_id long, query string")
    assert blockmax.pruned_top(blockmax.pack(ix), ix, questions, 3).count() == 0


def test_a_shard_is_small_by_default(spark):
    """A task sorts and searches a shard; it held eight times as many documents."""
    ix = index.build(spark.range(40_000).selectExpr("id AS doc_id", "'w1' AS text"))
    assert blockmax.shards(ix) == 3
    sizes = [r["n"] for r in blockmax.pack(ix).groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
    assert len(sizes) == 3 and sum(sizes) == 40_000 and max(sizes) < 1.2 * blockmax.SHARD_DOCS
