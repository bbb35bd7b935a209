"""Words and postings of the nearest examples: no memory of words met once, long queries piece by piece."""

import random
import tracemalloc

import numpy as np

from tests.llm import fixtures
from tracewright.llm import toxicity


def test_words_are_told_apart_without_a_memory():
    rng = random.Random(5)
    words = ["", "Ünï", "(Straße)", "--", "ABCDEFG", "abcdeXYZ,", "a", "İstanbulx", "x\x00yzabc", *(fixtures.prose(rng, 3, 900).replace(" ", "") for _ in range(300))]
    vocabulary = sorted({t for w in words for t in toxicity.terms_of(w.encode())})
    read = toxicity.Terms(vocabulary)
    number = {h: k for k, h in enumerate(read.hashes.tolist())}
    for w in words:
        want = sorted({number[h] for h in toxicity.hashed([t for x in w.split() for t in toxicity.terms_of(x.encode())]).tolist()})
        assert read.numbers(w) == want
    assert all(not w.isascii() for w in read.memo)


def test_a_long_query_takes_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 1000, raising=False)
    size, rng = 900, np.random.default_rng(2)
    dense = np.where(rng.random((2000, size)) < 0.5, rng.random((2000, size)), 0).astype(np.float32)
    dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
    index = toxicity.BlockMax([(np.flatnonzero(x).astype(np.int32), x[x > 0]) for x in dense], np.arange(2000), np.zeros(2000, int), size, common=100)
    query = (np.arange(size), np.full(size, size**-0.5))
    index.nearest_of([query], 9)
    tracemalloc.start()
    at, cosines = index.nearest_of([query], 9)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = dense.astype(float) @ query[1]
    want = np.lexsort((np.arange(2000), -np.round(every, 12)))[:9]
    assert index.ids[at].tolist() == want.tolist() and np.allclose(cosines, every[want], atol=1e-9)
    assert peak < 2_000_000  # 800,000 postings
