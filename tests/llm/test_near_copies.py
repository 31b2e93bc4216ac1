"""Near-dedup against all pairs of all texts: no bound on bits, no representatives."""

import random
import re
from itertools import combinations

import corpus_pipeline

from .test_id_ops import brute_fp


def shingles(t):
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, fps = [shingles(t) for t in texts], [brute_fp(t) for t in texts]
    far = 0
    for a, b in combinations(range(len(texts)), 2):
        bits = (fps[a] ^ fps[b]).bit_count()
        alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        far += alike and bits > 9
        if bits <= 3 or alike:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))], far


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_every_similar_pair_links_beyond_any_bits_and_through_merged_members(spark):
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(150):  # short texts: few changed shingles turn many bits
        w = rng.choices(vocab, k=rng.randrange(30, 60))
        texts.append(" ".join(w))
        texts.append(" ".join([*rng.choices(vocab, k=rng.randrange(1, 6)), *w]))
    for _ in range(12):  # copies edited a little at a time: the ends are far apart, each step is near
        w = rng.choices(vocab, k=80)
        for _ in range(12):
            texts.append(" ".join(w))
            w = w[rng.randrange(3, 7) :] + rng.choices(vocab, k=rng.randrange(3, 7))
    line = rng.choices(vocab, k=30)  # a line that many different texts have
    texts += [" ".join(line + rng.choices(vocab, k=60)) for _ in range(60)]
    rng.shuffle(texts)
    groups, far = brute_groups(texts)
    got = corpus_pipeline.near_dedup(spark, frame(spark, enumerate(texts)), "")
    assert [r.doc_id for r in got.orderBy("doc_id").collect()] == sorted(set(groups)) and far > 10


def test_null_and_repeated_ids_go_only_with_a_copy(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choices(["v%d" % i for i in range(500)], k=60)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, d), (3, d + " more"), (None, e), (None, e), (1, a)]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (None, b), (2, c), (2, d), (None, e)], key=str)
    assert corpus_pipeline.near_dedup(spark, frame(spark, rows).limit(0), "").count() == 0


def test_contaminated_rows_go_whatever_their_id(spark, tmp_path):
    rng = random.Random(10)
    item, a, b = (" ".join(rng.choices(["u%d" % i for i in range(500)], k=40)) for _ in range(3))
    spark.createDataFrame([(1, item), (None, "q1 q2 q3 q4 q5 q6")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item), (1, a + " " + item), (1, b), (2, a), (None, b), (3, "q1 q2 q3 q4 q5 q6"), (4, None), (5, "")]
    got = corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, b), (2, a), (None, b), (4, None), (5, "")], key=str)
