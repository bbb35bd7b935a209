"""Thousands of near copies of a few texts: counts of links and classes against all pairs, and rows that stay."""

import random

import numpy as np

from tests.llm import fixtures
from tracewright.llm import nearjoin


def all_pairs(sets, threshold=0.8):
    """(class as the least row, number of links) by one product of the whole 0/1 matrix."""
    names = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(names)), np.float32)
    for k, s in enumerate(sets):
        m[k, [names[x] for x in s]] = 1
    size = m.sum(1)
    common = m @ m.T
    linked = common >= threshold * (size[:, None] + size[None] - common) - 1e-6
    np.fill_diagonal(linked, False)
    label = np.arange(len(sets))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(sets)).min(1))
        if (new == label).all():
            return label, linked.sum(1)
        label = new


def near_copies(rng, n):
    bases = [fixtures.prose(rng, 150, 10**6).split() for _ in range(2)]
    for k in range(n):
        w = list(bases[k % 10 == 0])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"x{rng.randrange(3)}"
        yield " ".join(w)


def test_links_of_five_thousand(spark):
    texts = list(near_copies(random.Random(8), 5000))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label, links = all_pairs(sets)
    out = nearjoin.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in out}
    assert len(out) == 5000 and links.max() > 500 and links.min() < 10
    assert got == {k: (int(label[k]), int(links[k])) for k in range(5000)}


def test_edges_grow_with_members(spark):
    sets = [np.sort(np.asarray([hash((k, x)) & (2**63 - 1) for x in range(20)], np.uint64)) for k in range(40)]
    ids = np.arange(40)[::-1].copy()
    i, j = np.triu_indices(40, 1)
    a, b = nearjoin.least_joined(ids, i, j)
    assert sorted(a) == list(range(1, 40)) and set(b) == {0}
    assert nearjoin.intersections(sets, i, j).tolist() == [0] * len(i)


def test_repeated_rows_leave_one(spark):
    x, y = "one two three four five six seven", "q r s t u v w"
    rows = [(5, x), (5, x), (5, x), (6, x), (7, y), (7, x), (8, y), (None, x), (9, ""), (9, None), (7, "alone here we stand five six")]
    kept = nearjoin.one_of_each(spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, class_id string"))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(5, x), (7, y), (7, "alone here we stand five six"), (None, x), (9, ""), (9, None)]))
