"""The model of toxicity is files that workers map: no worker has a copy of the index of its own."""

import mmap

import numpy as np
import pytest

from tracewright.llm import toxicity


def base_of(x):
    while isinstance(x, np.ndarray):
        x = x.base
    return x


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "shared_dir", lambda spark: f"file://{tmp_path}/model")


def test_workers_map_the_index(spark, shared):
    rng, size = np.random.default_rng(6), 900
    dense = np.where(rng.random((200, size)) < 0.2, rng.random((200, size)), 0).astype(np.float32)
    dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
    vectors = [(np.flatnonzero(x).astype(np.int32), x[x > 0]) for x in dense]
    model = toxicity.sent(spark, np.arange(size, dtype=np.uint64), np.ones(size), vectors, np.arange(200), np.arange(200) % 2, 0.0, 0.5, 7)
    index, plain = model.value.index, toxicity.BlockMax(vectors, np.arange(200), np.arange(200) % 2, size)
    assert all(isinstance(base_of(x), mmap.mmap) for x in (index.terms, index.weights, index.postings, index.tables, model.value.idf))
    for (a, x), (b, y) in zip(index.nearest_of(vectors[:70], 7), plain.nearest_of(vectors[:70], 7), strict=True):
        assert index.ids[a].tolist() == plain.ids[b].tolist() and x.tolist() == y.tolist()


def test_an_index_of_nothing(spark, shared):
    model = toxicity.sent(spark, np.empty(0, np.uint64), np.empty(0), [], np.empty(0, np.int64), np.empty(0, np.int64), 0.0, 0.0, 7)
    assert model.value.scores([(np.empty(0, np.int64), np.empty(0))], np.empty(0), np.empty(0)) == [(0.0, [])]
