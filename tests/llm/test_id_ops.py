"""Sharding, SimHash, byte BPE and token files against brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from quill.llm import byte_bpe, sharding, simhash, token_files
from quill.llm.common import join_hot, scratch

TEXTS = [
    (1, "The Cat sat on the mat."), (2, "the cat sat on the mat."), (3, None), (4, ""), (5, "   \n\t "), (6, "naïve café é é <|endoftext|> it's 1234 !!??"),
    (7, "word " * 3000), (8, "x" * 70_000 + " end's  \n\n  tail   "), (None, "a null id"), (9, "one"), (9, "one"), (10, "日本語 テキスト　と 空白  \x1c y"), (11, ("ab 12, " * 9000) + " " * 3000 + "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "clash") for i, t in TEXTS], "doc_id long, text string, shard_note string, fp int, id string").repartition(3)


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text")
    got = sharding.assign(rows, "doc_id", sharding.tree(16), sharding.tree(17)).collect()
    assert len(got) == len(TEXTS)

    def draw(key, node):
        # Spark's hash of (long, string): the long's hash seeds the string's; a null long leaves the seed
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return -np.log(((xxhash.xxh64_intdigest(node.name.encode(), seed) >> 12) + 0.5) / 2**52) / node.weight

    def down(key, node):
        return node.shard if node.shard is not None else down(key, min(node.children, key=lambda c: draw(key, c)))

    for r in got:
        assert r.shard == down(r.doc_id, sharding.tree(16)) and r.grown_shard == down(r.doc_id, sharding.tree(17))
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(rows.limit(0), "doc_id", sharding.tree(16)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(rows.withColumnRenamed("text", "slot"), "doc_id", sharding.tree(4))


def test_sharding_spread(spark):
    got = sharding.assign(spark.range(40_000), "id", sharding.tree(16), sharding.tree(17))
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.12 * min(sizes)
    moved = got.where("grown_shard <> shard")
    assert {r[0] for r in moved.select("grown_shard").distinct().collect()} == {16} and 0.9 < moved.count() / (40_000 / 17) < 1.1


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(items, most=3):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(items)), 2):
        if (items[a][1] ^ items[b][1]).bit_count() <= most:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(items):
        r = find(k)
        least[r] = i if least.get(r) is None else (least[r] if i is None else min(i, least[r]))
    return sorted(((i, f, least[find(k)]) for k, (i, f) in enumerate(items)), key=str)


def test_simhash(spark, docs):
    want = brute_components([(i, brute_fp(t)) for i, t in TEXTS])
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = set(base)
    for b in base[:6]:
        for _ in range(250):  # a dense group: few blocks differ, so groups go over the limit
            codes.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))) & (2**64 - 1))
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    for limit in (4096, 50):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), 3, limit).collect()
        assert len(edges) < 12 * len(codes)
        forest = {c: c for c in codes}

        def find(x, forest=forest):
            while forest[x] != x:
                x = forest[x]
            return x

        for a, b in edges:
            forest[find(a % 2**64)] = find(b % 2**64)
        parts = {}
        for c in codes:
            parts.setdefault(find(c), set()).add(c)
        want = {}
        for i, _, least in brute_components([(c, c) for c in codes]):
            want.setdefault(least, set()).add(i)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_byte_bpe(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in TEXTS:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert byte_bpe.encode_digests(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_stitching():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "1", "'s", "!", "é", "don't", "x" * 30, " " * 25]) for _ in range(rng.randrange(0, 120)))
        assert byte_bpe.pretokens(t, pattern, 20, 8) == pattern.findall(t)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, scratch(spark, "t"), lambda: token_files.encoder(path), shards=4)
    got = token_files.read_token_files(manifest).collect()
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    shard = token_files.Shard(manifest.where("n_docs > 0").first()["uri"])
    assert shard.find(-12345) is None
    empty = token_files.write_token_files(docs.limit(0), scratch(spark, "t"), lambda: token_files.encoder(path), shards=1)
    assert token_files.read_token_files(empty).count() == 0


def test_mph():
    keys = [b"%d" % i for i in range(1000)]
    _, slots = token_files.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(1000))


def test_stretches_encode_as_the_whole_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), token_files.ChunkEncoder(path)
    rng = random.Random(8)
    bits = ["The", "cat", "sat.", ",", ".", " ", "  ", "\n", "\t", "é", "e\u0301", "H\u0331", "İ,", "Σ.", "don't", "DON'T,", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "|", "\u2003", "\x1c", "a.b,c", "ﬁ", "一,", "\u0301", "x\u0307."]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)] + [" ".join(rng.choices(bits, k=20)) for _ in range(2000)]
    for t, ids in zip(texts, enc.encode(pa.array(texts), block=500), strict=True):
        assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1], t


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    codes = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (2**64 - 1) for b in base for _ in range(20)})
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    for most in (5, 9):
        rows = [frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.near_pairs(frame, most).collect()]
        got = set(rows)
        assert len(got) == len(rows)  # each once
        assert got == {frozenset(x) for x in combinations(codes, 2) if (x[0] ^ x[1]).bit_count() <= most}


def test_representatives(spark):
    rng = random.Random(10)
    texts, kept = [], []
    for g in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(150)]
        kept.append(len(texts))
        for c in range(4):
            v = list(w)
            if c:
                v[10 * c] = "changed"
            texts.append((len(texts), " ".join(v)))
    texts += [(None, texts[0][1]), (0, texts[0][1])]
    got = [r.id for r in simhash.representatives(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, fp int")).collect()]
    assert len(got) == len(set(got)) and set(kept) <= set(got) and len(got) < 1.1 * len(kept)


def test_every_pair_goes_through_the_index():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    codes = np.unique(np.concatenate([base, *(b ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for b in base[:20])]))
    for most, agree in ((3, 1), (3, 2), (5, 3)):
        chosen = simhash.choices(most, agree)
        found = set()
        for m, names, index, first, last in simhash.indexes(np.repeat(np.arange(len(chosen)), len(codes)), np.tile(codes, len(chosen)), chosen):
            assert len(index.full) == 4 and (np.diff(simhash.gray_rank(index.codes).astype(float)) >= 0).all()
            for level, (mask, pat) in enumerate(zip(index.full, index.pat, strict=True)):  # a node's pattern is what its codes share
                for k in range(len(mask)):
                    below = index.codes[k * 8**level : (k + 1) * 8**level]
                    assert ((below & mask[k]) == pat[k]).all()
            q, node = index.search(index.codes, first, last, most)
            grouped = int(((last - first) > 1).sum())
            assert index.visited >= grouped  # each code of each group, however small, has searched the index
            found |= {frozenset((int(names[a]), int(names[b]))) for a, b in zip(q, node, strict=True) if a != b}
        assert found == {frozenset((int(a), int(b))) for a, b in combinations(codes, 2) if (int(a) ^ int(b)).bit_count() <= most}


def test_simhash_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.select("doc_id", "text").collect()])
    got = simhash.op8_simhash(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=str) == want and len({c for *_, c in want}) < len(want)


def test_hot_keys_join_where_they_lie(spark):
    rows = spark.createDataFrame([(k % 40 if k % 3 else 0, k) for k in range(3000)], "fp long, id long")
    per_key = rows.groupBy("fp").count().withColumnRenamed("count", "n")
    assert join_hot(rows, per_key, "fp").where("n IS NOT NULL").count() == 3000
