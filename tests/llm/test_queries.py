"""The registered queries themselves over the whole tables of sf0.001, against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm import fixtures
from tests.llm.test_nearjoin import brute
from tests.llm.test_scores import brute_license, brute_statistics
from tests.llm.test_texts import brute_substring
from tracewright.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(k): t if isinstance(t, str) else None for k, t in zip(d.doc_id, d.text, strict=True)}


def test_op1(spark, texts):
    out = queries.op1_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for s in range(8):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    assert 0 < sum(r.grown_shard == 8 for r in out) < len(out) / 3


def test_op3(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: r for r in queries.op3_sstable(spark, SF).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        r = out[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, texts):
    out = queries.op4_ngram_jaccard(spark, SF).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == brute(list(texts.items()))


def test_op5(spark, texts):
    out = queries.op5_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_substring(list(texts.items()), 50)


def test_op6(spark, texts):
    out = queries.op6_license_scan(spark, SF).collect()
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute_license(texts[r.doc_id])
    assert len(out) == len(texts)


def test_op7(spark, texts):
    out = queries.op7_quality(spark, SF).collect()
    known = pd.read_parquet(f"{SF}/labels.parquet").groupby("doc_id").quality.max().to_dict()
    for r in out:
        n = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.score >= 0.5)
    assert all(r.kept == known[r.doc_id] for r in out if r.doc_id in known and not r.base_failed)


def test_op10(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[doc_id, k] = (at, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))
    out = queries.op10_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def dense_scores(docs, labels, k=15):
    """Toxicity by dense matrices: every document against every example."""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs}
    examples = sorted(d for d in docs if d in labels and not held[d])
    terms = {d: Counter(t for w in (docs[d] or "").encode().split() for t in toxicity.terms_of(w)) for d in docs}
    y = np.asarray([labels[d] for d in examples])
    vocabulary = sorted({t for d in examples for t in terms[d]}, key=lambda t: t.encode())
    df = np.asarray([sum(t in terms[d] for d in docs) for t in vocabulary])
    c1 = np.asarray([sum(t in terms[d] for d, v in zip(examples, y, strict=True) if v) for t in vocabulary], float)
    c0 = np.asarray([sum(t in terms[d] for d, v in zip(examples, y, strict=True) if not v) for t in vocabulary], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(c > 0, c * np.log(c * (n0 + n1) / ((c0 + c1) * n)), 0.0) for c, n in ((c0, n0), (c1, n1)))
    weight = (np.log((1 + len(docs)) / (1 + df)) + 1) * (1 + np.where(c1 * n0 > c0 * n1, ratio, 0.0))

    def vector(d):
        n = np.asarray([terms[d].get(t, 0) for t in vocabulary], float)
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * weight
        return v / np.sqrt((v * v).sum()) if v.any() else v

    matrix = {d: vector(d) for d in docs}
    index = np.stack([matrix[d] for d in examples])
    share = y.mean()

    def raw(d, but=None):
        cosine = index @ matrix[d]
        if but is not None:
            cosine[but] = 0
        at = sorted(np.flatnonzero(cosine > 0), key=lambda p: (-round(cosine[p], 6), examples[p]))[:k]
        w = 1 / (1.05 - np.minimum(cosine[at], 1))
        return float((w @ y[at] + share) / (w.sum() + 1))

    x, p = toxicity.isotonic([(raw(d, i), int(y[i])) for i, d in enumerate(examples)], share)
    return {d: float(np.interp(raw(d), x, p)) for d in docs}


def test_op9_is_the_dense_search(spark):
    import random

    rng = random.Random(12)
    docs = {d: fixtures.prose(rng, 40, 900) + (" awful nasty" if d % 4 == 0 else " kind") for d in range(260)}
    labels = {d: int(d % 4 == 0) for d in range(200)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    out = toxicity.scored(frame, known).collect()
    want = dense_scores(docs, labels)
    assert max(abs(r.score - want[r.doc_id]) for r in out) < 1e-3 and len(out) == 260


def test_op9(spark, texts):
    out = queries.op9_toxicity(spark, SF).collect()
    known = pd.read_parquet(f"{SF}/labels.parquet").groupby("doc_id").toxic.max().to_dict()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    held = [r for r in out if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.95
    assert re.fullmatch("doc_id held_out score predicted.*", " ".join(out[0].asDict()))
