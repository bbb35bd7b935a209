"""Walks that are counted with chains as one node."""

import numpy as np

from tracewright.operators import traversal, walks


def test_chains_are_one_node():
    """A ring of 60 nodes with three short ways: few states, however long its chains are."""
    n = 60
    src = np.concatenate([np.arange(n), np.asarray([0, 20, 40])])
    dst = np.concatenate([(np.arange(n) + 1) % n, np.asarray([10, 30, 50])])
    want = walks.of_run(src, dst, traversal.STATES)
    assert want[:3] == (8, 33, 60)
    assert walks.of_run(src, dst, 150) == want
