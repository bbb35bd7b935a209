"""Windows that share the first of their two hashes are told apart by the second."""

import numpy as np

from tracewright.llm import substring


def test_pairs():
    x = np.asarray([5, 5, 5, 9, 9, 2], np.uint64)
    y = np.asarray([8, 7, 8, 1, 1, 3], np.uint64)
    d = np.asarray([4, 6, 2, 3, 3, 7], np.int64)
    a, b, low, high = substring.firsts_of(x, y, d)
    assert a.tolist() == [2, 5, 5, 9] and b.tolist() == [3, 7, 8, 1] and low.tolist() == [7, 6, 2, 3] and high.tolist() == [7, 6, 4, 3]
    own, second = np.asarray([5, 5, 5, 9, 1, 10], np.uint64), np.asarray([8, 7, 6, 1, 3, 1], np.uint64)
    assert substring.place_of(a, b, own, second).tolist() == [2, 1, -1, 3, -1, -1]


def test_ranges():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    for shift in (64, 63, 60, 50):
        parts = substring.ranges_of(x, shift)
        assert np.concatenate([x[a:b] for _, a, b in parts]).tolist() == x.tolist()
        for r, a, b in parts:
            assert substring.between(x, r, shift).tolist() == x[a:b].tolist()
    assert substring.ranges_of(x[:0], 60) == [] and not len(substring.between(x[:0], 1, 60))
