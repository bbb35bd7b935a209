"""The dense table of the nearest examples stays within its bound, and cosines are those of plain sums."""

import numpy as np

from tracewright.llm import toxicity


def test_the_dense_table_is_bounded():
    rng, size = np.random.default_rng(4), 1500
    dense = np.where(rng.random((300, size)) < 0.2, rng.random((300, size)), 0).astype(np.float32)
    dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
    vectors = [(np.flatnonzero(x).astype(np.int32), x[x > 0]) for x in dense]
    index = toxicity.BlockMax(vectors, np.arange(300), np.zeros(300, int), size)
    every = dense.astype(float) @ dense.T.astype(float)
    for q, (at, cosines) in enumerate(index.nearest_of(vectors[:70], 9, [index.place_of[q] for q in range(70)])):
        want = np.argsort(-every[q] + 9 * (np.arange(300) == q), kind="stable")[:9]
        assert index.ids[at].tolist() == want.tolist() and np.allclose(cosines, every[q, want], atol=1e-6)
    held = index.tables if isinstance(index.tables, np.ndarray) else index.tables[0]
    assert held.nbytes <= 512 * 320 * 4
