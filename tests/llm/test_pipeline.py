"""The pipeline against a brute-force version of each stage, stage by stage on what the one before kept."""

import base64
import hashlib

import public_tokenizers

import corpus_pipeline
from quill.llm import quality
from quill.llm.common import materialize

from .test_near_copies import brute_groups
from .test_text_ops import brute_substrings, norm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    names, results = [], []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = materialize(stage(spark, docs, SF), "stage")
        names.append(name)
        results.append((before, docs.orderBy("doc_id").collect()))
    before, after = results[0]
    assert [r.doc_id for r in after] == [r.doc_id for r in before if model.score(r.text) >= 0.3] and 0 < len(after) < len(before)
    assert all(a == b for a, b in zip(after, [r for r in before if r.doc_id in {x.doc_id for x in after}], strict=True))

    before, after = results[1]
    groups, far = brute_groups([r.text for r in before])  # by plain similarity of all texts, whatever their bits
    assert [r.doc_id for r in after] == [before[k].doc_id for k in sorted(set(groups))] and len(after) < len(before) and far

    before, after = results[2]
    want = [(i, sha) for i, n, gone, sha in brute_substrings([(r.doc_id, r.text) for r in before]) if gone == 0 or gone < n]
    got = sorted((str(r.doc_id), hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in after)
    assert got == sorted(want) and all(r.n_chars == len(r.text) for r in after)

    before, after = results[3]
    items = [set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (norm(r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    clean = []
    for r in before:
        w = norm(r.text).split()
        have = set(zip(*(w[k:] for k in range(5)), strict=False))
        if not any(len(have & s) >= 0.8 * len(s) for s in items if s):
            clean.append(r)
    assert [tuple(r) for r in after] == [tuple(r) for r in clean] and len(after) < len(before)

    before, after = results[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [(r.doc_id, r.n_tokens) for r in after] == [(r.doc_id, len(plain.encode_ordinary(r.text))) for r in before]
    assert all(hashlib.sha256(b.text.encode()).hexdigest() == a.decoded_sha256 for a, b in zip(after, before, strict=True))

    out = corpus_pipeline.run(spark, SF)  # all stages by themselves give the same rows
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in after)
