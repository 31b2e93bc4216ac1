"""Decontamination, HTML, quality, LM scoring, substring and embedding dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quill.llm import decontamination, embeddings, html_text, lattice_lm, quality, substrings


def norm(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip()


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_decontamination(spark):
    rng = random.Random(1)
    vocab = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 12, 31, 32, 60])))) for i in range(25)] + [(98, None), (99, ""), (100, "..."), (0, "Repeated id, another text of words here"), (0, "w1 w2 w3 w4 w5 w6 w7"), (None, "w9 w8 w7 w6 w5 w4"), (None, "w9 w8 w7 w6 w5 w4")]
    docs = []
    for d in range(80):
        w = rng.choices(vocab, k=rng.choice([0, 4, 30, 400]))
        for _ in range(rng.randrange(3)):
            it = items[rng.randrange(25)][1].split()
            if rng.random() < 0.5:
                it[rng.randrange(len(it))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = it
        docs.append((d if d % 9 else None, ", ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(1, docs[1][1]), (500, None), (501, ""), (502, "w9 w8 w7 w6 w5 w4, w1 w2 w3 w4 w5 w6 w7"), (None, "W9 w8 w7 w6 w5 w4")]
    want = {}
    for d, t in docs:
        s = f" {norm(t)} "
        for i, q in items:
            qw = norm(q).split()
            k = min(5, len(qw))
            sh = {" ".join(qw[j : j + k]) for j in range(len(qw) - k + 1)} if qw else set()
            n = sum(f" {x} " in s for x in sh)
            if sh and n >= math.ceil(0.8 * len(sh) - 1e-9):
                want[d, i] = max(want.get((d, i), (0, 0, 0)), (n / len(sh), n, len(sh)))
    frame = spark.createDataFrame([(d, t, "n", 7) for d, t in docs], "doc_id long, text string, item string, n long").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(frame, bench).collect()
    got = {(r.id, r.item): (r.containment, r.n_found, r.n_shingles) for r in rows}
    assert got == want and len(want) > 20 and len(rows) == len(got) and (502, None) in got and (None, None) in got
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>One menu</a></li><li>Two</li></ul></nav><div class="cookie-notice">We use cookies to do many long things indeed, please accept them.</div>
<div class="ad">Buy &amp; save lots of money today with this offer.</div>
<article><h1>The  title</h1><p><b>First &lt;para&gt; of text&nbsp;that goes on for a while, with <a href="#">a link</a> in it.<br>next<p>Second paragraph is also long enough to be seen as text.</p><p>Short.</p><aside>An aside.</aside></article>
<section id="comments"><p>A reader comment that is rather long, too, as such things go, and longer still.</p></section>
<form><label>Name</label><input></form><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    want = "The title\nFirst <para> of text that goes on for a while, with a link in it. next\nSecond paragraph is also long enough to be seen as text.\nShort."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE[: PAGE.index("</article>")]) == want
    long = "<body><div class=x><p>" + "word " * 40 + "</p><p>a</p></div><div><a>m</a><a>n</a></div></body>"
    assert html_text.main_text(long) == ("word " * 40).strip() + "\na"
    named = '<body class="with-sidebar"><div class="page no-sidebar has-comments"><div class=banner><article><p>Text of the article, long enough.</p></article></div><section id=comments><article class=comment><p>A reader says something long here, too.</p></article></section></div></body>'
    assert html_text.main_text(named) == "Text of the article, long enough."
    for junk in (None, "", "<", "<p", "<p>", "&amp", "plain text", "<script>x", "<!--", "<nav>only</nav>", "</p></div>"):
        assert isinstance(html_text.main_text(junk), str)
    assert html_text.main_text("plain text") == "plain text"
    rows = [(1, "u", PAGE, "t"), (1, None, None, "t"), (None, "v", "", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.url, r.n_chars, len(r.text)) for r in got if r.url) == [("1", "u", len(want), len(want)), ("None", "v", 0, 0)]
    assert len(got) == 3


def test_quality(spark):
    rng = random.Random(2)
    vocab = ["lorem%d" % i for i in range(300)]

    def good():
        return "\n".join(" ".join(rng.choices(vocab, k=30)).capitalize() + "." for _ in range(rng.randrange(1, 9)))

    def bad():
        return rng.choice([" ".join([w for w in rng.choices(vocab, k=4) for _ in range(30)]), " | ".join(rng.choices(vocab, k=50)), "!! ".join(rng.choices(vocab, k=50)).upper()])

    docs = [(i, good() if i % 2 else bad()) for i in range(600)]
    labels = [(i, i % 2) for i in range(600)] + [(None, 1), (3, None)]
    frame = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, "x\n\ny")], "doc_id long, text string")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"), sample=300)
    got = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == i % 2 for i in held) / len(held) > 0.97
    none = quality.train(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(frame, none).collect())


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, step = rng.standard_normal((1, 4, 2)), rng.standard_normal((2, 2))
    z, m, moves = quality.forward_backward(e, np.array([4]), step)
    total, good, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        p = math.exp(sum(e[0, i, y[i]] for i in range(4)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            pairs[a, b] += p
    assert np.allclose(z, math.log(total)) and np.allclose(m[0, :, 1], good / total) and np.allclose(moves, pairs / total)


def brute_marginal(lattice, names, word):
    logs = dict(zip(names, lattice.logs, strict=True))
    w = b" " + word
    alpha = [0.0] + [-math.inf] * len(w)
    for t in range(1, len(w) + 1):
        terms = [alpha[s] + logs[w[s:t]] for s in range(t) if w[s:t] in logs]
        alpha[t] = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))
    return alpha[-1]


def test_lattice(monkeypatch):
    names, logs = lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice = lattice_lm.Lattice(names, logs)
    long = max(names, key=len)
    words = [b"the", b"", b"tionable", "été".encode(), b"\xff\xfe", b"x" * 700, b"hello", long.strip(), b"a" + long.strip() * 3 + b"\xff"]
    assert len(long) > 16
    assert np.allclose(lattice.marginals(words), [brute_marginal(lattice, names, w) for w in words])
    small = [b"the", b"hello", b"abc"]
    n = lattice.expected(small)
    bytes_seen = sum(len(names[i]) * n[i] for i in np.nonzero(n)[0])
    assert abs(bytes_seen - sum(len(w) + 1 for w in small)) < 1e-6
    # tables of few cells at a time give the same, and so do counts by a change of the log marginal with a piece's weight
    whole, many = lattice.marginals(words), lattice.expected(words)
    monkeypatch.setattr(lattice_lm, "CELLS", 50)
    assert np.allclose(lattice.marginals(words), whole) and np.allclose(lattice.expected(words), many)
    monkeypatch.undo()
    for i in (names.index(b" the"), names.index(b"t"), names.index(long)):
        up = logs.copy()
        up[i] += 1e-6
        slope = (lattice.marginals(words, [up]) - whole).sum() / 1e-6
        assert abs(slope - many[i]) < 1e-3


def test_a_hash_alone_makes_no_piece():
    names, logs = [bytes([x]) for x in range(256)] + [b" a", b"abcdefghijk"], np.full(258, -5.0)
    lattice = lattice_lm.Lattice(names, logs)
    lattice.tails[0][256] += 1  # as if another string had this piece's hash
    lattice.tails[1][257] += 1
    assert np.allclose(lattice.marginals([b"abcdefghijk"]), -5.0 * 12)


def test_lattice_lm(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "a mat\n", "été", "word%d" % rng.randrange(80)]) for _ in range(rng.randrange(40)))) for i in range(200)]
    texts += [(None, "null id here"), (7, None), (7, ""), (900, "y" * 5000), (7, "The cat")]
    frame = spark.createDataFrame([(i, t, 1.0, "w", ["en", "fr", None][k % 3]) for k, (i, t) in enumerate(texts)], "doc_id long, text string, score double, word string, lang string").repartition(3)
    got = lattice_lm.score(frame, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(texts)

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 10 == 0

    def tokens(t):
        return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + [b"\n"]

    c = Counter(w for i, t in texts if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in texts)
    assert want == sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice_lm.score(frame.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def brute_substrings(texts, window=50):
    first = {}
    for i, t in texts:
        w = words_of(t)
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in texts:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    rng = random.Random(6)
    vocab = ["v%d" % i for i in range(500)] + ["é", "the"]
    passages = [rng.choices(vocab, k=k) for k in (49, 50, 51, 60, 200)] + [["the"] * 90, ["a", "b"] * 40]
    texts = []
    for d in range(120):
        w = rng.choices(vocab, k=rng.randrange(100))
        for _ in range(rng.randrange(3)):
            p = passages[rng.randrange(len(passages))]
            at = rng.randrange(len(w) + 1)
            a = rng.randrange(0, 4) * (len(p) > 55)
            w[at:at] = p[a:]
        texts.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    texts += [(3, texts[90][1]), (None, texts[50][1]), (None, None), (400, texts[10][1]), (401, texts[10][1]), (402, ""), (403, None), (404, "x " * 4000), (405, "x " * 3000)]
    frame = spark.createDataFrame([(i, t, "h", 5) for i, t in texts], "doc_id long, text string, hashes string, starts int").repartition(4)
    rows = substrings.dedupe(frame, carry=("hashes",)).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_substrings(texts)
    for r in rows:
        assert hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == r.kept_sha256 and r.hashes == "h"
    source = {i: t for i, t in texts}
    assert all(r.text == source[r.id] for r in rows if r.n_removed == 0 and r.id in range(4, 120) and r.text)
    assert substrings.dedupe(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.dedupe(frame, carry=("text",))


def test_a_passage_of_many_documents_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SHARE", 2000)
    monkeypatch.setattr(substrings, "HOT_PARTS", 5)
    rng = random.Random(12)
    vocab = ["v%d" % i for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    texts = [(i, " ".join([*rng.choices(vocab, k=rng.randrange(30)), *passage, *rng.choices(vocab, k=i % 7)])) for i in range(300)]
    texts += [(1000 + i, " ".join(rng.choices(vocab, k=40) * 2)) for i in range(20)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedupe(frame, with_text=False).collect())
    assert got == brute_substrings(texts)


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 24))
    rows = []
    for k in range(60):
        for _ in range(1 if k > 6 else 40):
            rows.append(base[k] + rng.standard_normal(24) * (0.0 if k == 3 else 0.12 if k < 7 else 0))
    rows += [base[3]] * 30 + [base[3] * 2.5]
    data = [(i, v.astype(np.float32).tolist(), int(i % 7 == 0)) for i, v in enumerate(rows)]
    data += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [1.0, None], 0), (2004, [float("nan")] * 24, 0), (2005, [float("inf"), 1.0], 0), (2006, data[0][1], None), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [1e-30] * 3, 0), (2010, [1e30] * 3, 0)]
    ok = {}
    for i, v, label in data:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float64)
            u = u / np.abs(u).max()
            ok[i] = (label, u / np.linalg.norm(u))
    parent = {i: i for i, *_ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    ids = list(ok)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            (la, u), (lb, w) = ok[ids[a]], ok[ids[b]]
            if la == lb and len(u) == len(w) and float(u @ w) >= 0.93:
                n[ids[a]] += 1
                n[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    want = sorted((i, n[i], find(i), find(i) == i) for i, *_ in data)
    frame = spark.createDataFrame([(*r, 3) for r in data], "vec_id long, embedding array<float>, label int, copies int").repartition(3)
    for limit in (8192, 20):
        got = sorted(tuple(r) for r in embeddings.near_duplicates(frame, limit=limit).collect())
        assert got == want
    assert sum(n.values()) > 2000
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 11, 50, 51, 300])
def test_offered_phrases_cover_every_window(n):
    rng = random.Random(n)
    w = [b"%d" % rng.randrange(9) for _ in range(n)]
    p = substrings.phrase_hashes(w)
    chosen = set(substrings.offered(p).tolist())
    for j in range(n - 49):
        assert min(p[j : j + 39].tolist()) in chosen


def test_lattice_lm_beats_the_base_where_texts_are_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model")).where("held_out").collect()
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)



def segmentations(w, names):
    if not w:
        yield ()
    for k in range(1, len(w) + 1):
        if w[:k] in names:
            for rest in segmentations(w[k:], names):
                yield (w[:k], *rest)


def test_lattice_lm_score_is_the_total_probability(spark):
    """Every segmentation of every word listed, for a corpus of short words in three classes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(11)
    vocab = ["the", "ton", "añb", "Xq", "in", "zz9", "of"]
    texts = [(i, " ".join(rng.choices(vocab[: 3 + i % 4], k=rng.randrange(6))), ["en", "fr", None][i % 3]) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.id: r.score for r in lattice_lm.score(frame, path).collect()}

    names, logs = lattice_lm.vocabulary(path)
    first = dict(zip(names, logs, strict=True))
    ways = {}
    models, shares = [], []
    for lang in ("en", "fr", None):
        own = [t for i, t, x in texts if x == lang and zlib.crc32(str(i).encode()) % 10]
        c = Counter(w for t in own for w in [*(x.lower() for x in t.split()), "\n"])
        n, v = sum(c.values()), len(c)
        d = min(0.95, max(0.05, sum(k == 1 for k in c.values()) / max(1, sum(k == 1 for k in c.values()) + 2 * sum(k == 2 for k in c.values()))))
        counts = Counter()
        for w in c:
            if w != "\n":
                ways[w] = list(segmentations(b" " + w.encode(), first))
                p = [math.exp(sum(first[x] for x in s)) for s in ways[w]]
                for s, q in zip(ways[w], p, strict=True):
                    for x in s:
                        counts[x] += q / sum(p)
        weight = {x: round(counts[x], 6) + 0.01 for x in names}
        total = sum(weight.values())

        def prob(w, c=c, n=n, v=v, d=d, weight=weight, total=total):
            seen = max(c[w] - d, 0) / n
            if w == "\n":
                return seen
            ways.setdefault(w, list(segmentations(b" " + w.encode(), first)))
            return seen + d * v / n * sum(math.prod(weight[x] / total for x in s) for s in ways[w])

        models.append(prob)
        shares.append(len(own))
    for i, t, _ in texts:
        want = sum(share / sum(shares) * math.prod(p(w) for w in [*(x.lower() for x in t.split()), "\n"]) for p, share in zip(models, shares, strict=True))
        assert abs(got[i] - math.log10(want)) < 1e-4, (t, got[i], math.log10(want))
