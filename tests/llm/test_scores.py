"""Decontamination, license scans, quality rules, token counts and toxicity."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm import fixtures
from tracewright.llm import decontamination, licenses, quality, tokencounts, toxicity


def edits_within(segment: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def planted():
    rng = random.Random(2)
    items = [(k, fixtures.prose(rng, rng.choice([12, 40, 60]), 10**5)) for k in range(12)]
    docs = []
    for d in range(40):
        text = fixtures.prose(rng, 80, 10**5)
        if d % 4 == 0:
            own = list(items[d % 12][1])
            for _ in range(d % 8):
                own[rng.randrange(len(own))] = rng.choice("xyz")
            text = text[:200] + " " + "".join(own) + " " + text[200:]
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("block_bytes", [16 << 20, 1000])
def test_leaks_equal_brute_force(spark, block_bytes):
    docs, items = planted()
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()}
    index = decontamination.Index(items, 0.08, 96, 40)
    want = {}
    for d, text in docs:
        for item, segment, e, _ in index.segments:
            n = edits_within(segment, decontamination.folded(text))
            if n <= e:
                want[d, item] = min(n, want.get((d, item), n))
    assert got == want and len(want) >= 9


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(2))
        n = edits_within(a, b)
        assert decontamination.banded_distance(a, b, 20)[0] == n


def test_leaks_odd(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "q " * 30)], "item_id long, text string")
    assert decontamination.leaks(fixtures.empty(spark), bench).count() == 0
    assert decontamination.leaks(fixtures.docs(spark), bench.limit(0)).count() == 0
    assert [r.doc_id for r in decontamination.leaks(fixtures.odd(spark), bench).collect()] == [-3]
    assert decontamination.decontaminated(fixtures.odd(spark), bench).count() == 6


LICENSED = [
    "Released under the MIT License. MIT license",
    "x Apache-License, version gnu GENERAL public license cc by nc cc-by",
    "Licensed under the Apache License, Version 2.0.",
    "one two three. This work is licensed under the GNU General Public License, version 3. more words " * 5,
    "released under mit",
    "the license of this work",
    "mit licenses, amit license",
    None,
    "",
    "  ...  ",
    "é mit\nlicense",
]


def brute_license(text, threshold=0.8, block=32):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for s in range(0, max(1, len(w)), block // 2):
        own = set(w[s : s + block])
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            share = len(t & own) / len(t)
            if share >= threshold - 1e-9:
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def test_licenses(spark):
    texts = [*LICENSED, *[r[1] for r in fixtures.rows()]]
    out = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute_license(texts[r.doc_id]), texts[r.doc_id]
    assert licenses.scanned(fixtures.empty(spark)).count() == 0
    assert {r.in_score for r in licenses.scanned(fixtures.odd(spark)).collect()} == {"mine"}


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_statistics():
    rng = random.Random(8)
    texts = [r[1] for r in fixtures.rows()] + ["".join(rng.choices(["a", "b", " ", "\n", "#", " ", "é"], k=rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_statistics(t), t


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    k = quality.FEATURES.index("symbols")
    y = ((x[:, k] < 0.5) ^ (rng.random(3000) < 0.05) | (x[:, k] > 0.9)).astype(float)
    model = quality.grow(x, y)
    grid = np.repeat(x[:50], 40, 0)
    grid[:, k] = np.tile(np.linspace(0, 1, 40), 50)
    s = model.score(grid).reshape(50, 40)
    assert (np.diff(s, axis=1) <= 1e-12).all() and s[:, 0].mean() > 0.8
    free = quality.FEATURES.index("word_length")
    y = (x[:, free] > 0.4) & (x[:, free] < 0.7)
    assert ((quality.grow(x[:2000], y[:2000].astype(float)).score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97


def test_quality_query(spark):
    docs = spark.createDataFrame([(k, ("*** " if k % 3 == 0 else "") * 30 + fixtures.prose(random.Random(k), 80)) for k in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in out if not r.base_failed) and len(out) == 150
    assert {r.kept for r in quality.judged(docs, labels.limit(0)).collect() if not r.base_failed} == {True}
    assert quality.judged(fixtures.empty(spark), labels).count() == 0
    assert quality.judged(fixtures.odd(spark), labels).count() == 7


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = tokencounts.vocabulary(path)
    whole = Tokenizer(models.Unigram(pieces, 0, True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(6)
    texts = [r[1] for r in fixtures.rows()] + ["".join(rng.choices(["a", "er", " ", "\n", "th", "é", "日", "🙂", "ing", "x", "<0x41>"], k=rng.randint(0, 40))) for _ in range(500)]
    out = tokencounts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert all(r.n_tokens == len(whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in out) and len(out) == len(texts)
    assert tokencounts.token_counts(fixtures.empty(spark), path).count() == 0
    assert tokencounts.token_counts(fixtures.odd(spark), path).count() == 7


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)).round(1) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMax(vectors, list(range(300)), [0] * 300, 40, block=8)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        cosine = dense @ q
        want = sorted((-round(c, 9), i) for i, c in enumerate(cosine) if c > 0)[:7]
        at, c = index.nearest(t, w, 7)
        assert [-x for x, _ in want] == pytest.approx(c.tolist(), abs=1e-8)
        assert set(index.ids[at][c > c[-1] + 1e-9]) == {i for x, i in want if -x > c[-1] + 1e-9}


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    bad = ["awful", "nasty", "vile"]
    docs = []
    for k in range(900):
        w = fixtures.prose(rng, 60, 3000).split()
        if k % 5 == 0:
            for b in rng.sample(bad, 2):
                w[rng.randrange(60)] = b
        docs.append((k, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(900)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(frame, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.evidence and r.evidence[0].similarity > 0 for r in held if r.predicted)
    # A held-out label is never learnt from.
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) toxic")
    assert {r.doc_id: r.score for r in toxicity.scored(frame, flipped).collect()} == {r.doc_id: r.score for r in out}
    assert {r.score for r in toxicity.scored(frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(fixtures.empty(spark), labels).count() == 0
    assert toxicity.scored(fixtures.odd(spark), labels).count() == 7
