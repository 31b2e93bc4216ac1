"""Packing, spelling variants, alignment and the encoders under them against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quill.llm import alignment, packing, spelling, stretches
from quill.llm.common import materialize

SF = "/root/testdata/sf0.001"
JSON, MODEL, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
TEXTS = [
    (1, "The cat sat on the mat, slowly."), (2, "The cat sat on the mat, slowly."), (3, None), (4, ""), (5, "   \n\t "), (6, "naïve café é × ÷ é <|endoftext|>  <s> it's 1234 !!??\nNext."),
    (7, "word " * 3000), (8, "x" * 3000 + " end's  \n\n  tail   "), (None, "a null id"), (9, "one"), (9, "one"), (10, "日本語 テキスト　と 空白  \x1c y ▁"), (11, ("ab 12, " * 900) + " " * 300 + "z"), (12, "nul \x00 byte ﬁ"),
]
PARTS = ["a", "b", "é", "Ж", " ", "  ", "\n", ".", ",", "'s", "1", "-", "\t", "<|endoftext|>", "日", "\x00", "▁", "\xa0", "ﬁ", "é", "😀", "th", "er", "İ", "　", "\r", "×", "A", "ɏ", "ʰ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in TEXTS], "doc_id long, text string, ids string, part int, offset int, word int, uid int").repartition(3)


def rows_of(sf_dir, spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def brute_ids(special=True):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = not special
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda: stretches.ByteLevelStretches(JSON, PATTERN), lambda: stretches.ByteLevelStretches(JSON, PATTERN, False), lambda: stretches.PieceStretches(MODEL)])
def test_stretches_give_the_ids_of_whole_texts(make):
    rng, enc = random.Random(1), make()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(4000)] + [t for _, t in TEXTS]
    space = isinstance(enc, stretches.PieceStretches)
    for arr in (pa.array(texts, pa.string()), pa.array(["skipped", *texts], pa.string()).slice(1)):
        ids, at = enc.batch(arr)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == (enc.whole_ids((" " if space else "") + t) if t else []), repr(t)
    assert len(enc.batch(pa.array([], pa.string()))[0]) == 0
    if not space:
        assert enc.ranks is not None
        enc.ranks, enc.known = None, {}
        assert enc.batch(pa.array(texts[:300], pa.string()))[0].tolist() == [i for t in texts[:300] for i in enc.whole_ids(t)]
    else:
        enc.by_stretch = False
        assert enc.batch(pa.array(texts[:300], pa.string()))[0].tolist() == [i for t in texts[:300] if t for i in enc.whole_ids(" " + t)]


def fewest(items, capacity):
    """The least number of sequences, by trying every packing."""
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_least_number_of_sequences():
    rng, fixed_any = random.Random(3), 0
    for _ in range(800):
        capacity = rng.choice([7, 10, 20, 50])
        items = [rng.randint(max(1, capacity // rng.choice([2, 5, 9])), capacity) for _ in range(rng.randrange(1, 11))]
        counts = [items.count(s) for s in range(capacity + 1)]
        steps = packing.reduce(counts, capacity)
        fixed, rest = sum(n for _, n in steps), [s for s in range(capacity + 1) for _ in range(counts[s])]
        fixed_any += fixed
        assert fixed + fewest(rest, capacity) == fewest(items, capacity)
        steps += packing.best_fit(counts, capacity)
        used = Counter()
        for held, n in steps:
            assert sum(s * k for s, k in held) <= capacity
            used.update({s: k * n for s, k in held})
        assert used == Counter(items)
    assert fixed_any > 1000


def test_best_fit_is_the_sequential_one():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(40))), reverse=True)
        rooms = []
        for s in items:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - s)
        assert sum(n for _, n in packing.best_fit([items.count(s) for s in range(capacity + 1)], capacity)) == len(rooms)


def test_a_plan_is_bounded_by_the_capacity():
    small, large = ({s: rng.randrange(10**k) for s in range(1, 1025)} for k, rng in ((3, random.Random(1)), (11, random.Random(2))))
    assert len(packing.plan(small)) < 4096 and len(packing.plan(large)) < 4096
    assert packing.plan({}) == []


def check_packing(got, texts):
    encode, want, taken = brute_ids(), [], Counter()
    for i, t in texts:
        ids = [*encode(t or ""), 2]
        n = -(-len(ids) // 1024)
        cuts = [0, *[len(ids) - 1024 * k for k in range(n - 1, -1, -1)]]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == taken[r["sequence_id"]]
        taken[r["sequence_id"]] += r["length"]
    assert max(taken.values()) <= 1024
    return len(taken), sum(w[3] for w in want)


def test_packing(spark, docs):
    pieces = materialize(packing.encode_pieces(docs, lambda: stretches.byte_level(JSON, PATTERN)), "pieces")
    packed = packing.pack(pieces).collect()
    got = [r.asDict() | {"doc_id": r["id"], "ids_crc32": zlib.crc32(r["ids"])} for r in packed]
    n, ids = check_packing(got, TEXTS)
    assert n == -(-ids // 1024)  # as few as there can be
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sorted(r["sequence_id"] for r in whole) == list(range(n))
    by_place = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed}
    for r in whole:
        assert bytes(r["ids"]) == b"".join(by_place[r["sequence_id"], p["offset"]] for p in r["pieces"])
    assert packing.pack(materialize(packing.encode_pieces(docs.limit(0), lambda: stretches.byte_level(JSON, PATTERN)), "pieces")).count() == 0


def test_packing_query(spark):
    n, ids = check_packing([r.asDict() for r in packing.op11_packing(spark, SF).collect()], rows_of(SF, spark))
    assert n <= 1.01 * ids / 1024 + 1


def brute_variants(texts, min_length=7, min_count=2, factor=10, noise=31):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if len(a) == len(b):
                one = sum(x != y for x, y in zip(a, b, strict=True)) == 1
            else:
                lo, hi = sorted((a, b), key=len)
                one = len(hi) - len(lo) == 1 and any(hi[:k] + hi[k + 1 :] == lo for k in range(len(hi)))
            if one:
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= factor * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_spelling(spark, group):
    rng = random.Random(6)
    base = ["receive", "aaaaaaa", "separately", "naïveté", "Éclairée", "ÀÉÎÕÜàéîõü", "colouring", "aabbccddee"]
    texts = [(None, "Receive receive"), (1, None), (2, ""), (3, "x×y÷zzzz abcdefg ABCDEFG")]
    for i in range(300):
        line = []
        for _ in range(40):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeéÉz") + w[k:], w[:k] + rng.choice("aeéÉz") + w[k + 1 :], w])
            line.append(w.title() if rng.random() < 0.1 else w)
        texts.append((i, " ".join(line)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.variants(spelling.noisy_words(docs), group=group).fillna({"form": "", "form_n": -1})
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()) == brute_variants(texts)
    assert spelling.variants(spelling.noisy_words(docs.limit(0))).count() == 0


def test_chains_of_forms(spark):
    counts = {"abcdefgh": 10**4, "abcdefghi": 10**3, "abcdefghij": 100, "abcdefghijk": 10, "abcdefghijkl": 1, "abcdefgz": 2, "abcdefgy": 10**4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words).collect()}
    assert got["abcdefghijkl"]["form"] == "abcdefghijk" and got["abcdefghijkl"]["root"] == "abcdefgh"
    assert got["abcdefgz"]["form"] == "abcdefgh" and got["abcdefgz"]["n_near"] == 2  # a tie: the first
    assert got["abcdefgh"]["form"] is None and got["abcdefgh"]["root"] == "abcdefgh" and got["abcdefgh"]["form_n"] is None


def brute_alignment(texts):
    a_enc, b_enc = stretches.ByteLevelStretches(JSON, PATTERN, False), stretches.PieceStretches(MODEL)
    encode_a, rows, docs_of = brute_ids(False), [], defaultdict(set)
    for k, (i, t) in enumerate(texts):
        want = (" " + t).encode() if t else b""
        a, b = (encode_a(" " + t), b_enc.whole_ids(" " + t)) if t else ([], [])
        if b"".join(a_enc.bytes_of[x] for x in a) != want or b"".join(b_enc.bytes_of[x] for x in b) != want:
            a, b = [], []
        spans = []
        for ids, of in ((a, a_enc.bytes_of), (b, b_enc.bytes_of)):
            ends = np.cumsum([len(of[x]) for x in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1][: len(b)] if s < v and u < e] if len(a) * len(b) < 10**6 else None
        if links is None:  # quadratic is too slow: both lists are walked together
            links, p, q = [], 0, 0
            while p < len(a) and q < len(b):
                links.append((a[p], b[q]))
                e, v = spans[0][p][1], spans[1][q][1]
                p, q = p + (e <= v), q + (v <= e)
        bounds = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(x) for s, _, x in side if lo <= s < hi) for side in spans) for lo, hi in zip([0, *bounds], bounds, strict=False)) if len(bounds) < 2000 else None
        for link in set(links):
            docs_of[link].add(k)
        rows.append((i, len(a), len(b), len(bounds), links, "" if not a else groups and hashlib.sha256(groups.encode()).hexdigest()))
    best = Counter()
    for (x, _), held in docs_of.items():
        best[x] = max(best[x], len(held))
    return [(i, na, nb, ng, len(ls), sum(len(docs_of[x]) == best[x[0]] for x in ls), sum(len(docs_of[x]) for x in ls), sha) for i, na, nb, ng, ls, sha in rows]


def assert_aligned(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))


FIELDS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1, 20, alignment.HOT])
def test_alignment(spark, docs, hot):
    aligned = materialize(alignment.align_texts(docs, lambda: stretches.byte_level(JSON, PATTERN, False), lambda: stretches.pieces(MODEL)), "aligned")
    counts = materialize(alignment.link_counts(aligned), "counts")
    assert_aligned([tuple(r[c] for c in FIELDS) for r in alignment.with_counts(aligned, counts, hot).collect()], brute_alignment(TEXTS))
    links = alignment.links_of(aligned).collect()
    assert sum(r["times"] for r in links) == sum(r["n_links"] for r in aligned.collect())
    none = materialize(alignment.align_texts(docs.limit(0), lambda: stretches.byte_level(JSON, PATTERN, False), lambda: stretches.pieces(MODEL)), "aligned")
    assert alignment.with_counts(none, materialize(alignment.link_counts(none), "counts")).count() == 0


def test_alignment_query(spark):
    got = [tuple(r[c] for c in ["doc_id", *FIELDS[1:]]) for r in alignment.op13_alignment(spark, SF).collect()]
    assert_aligned(got, brute_alignment(rows_of(SF, spark)))
