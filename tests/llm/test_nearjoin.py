"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import fixtures
from tracewright.llm import nearjoin


def brute(rows, threshold=0.8, size=5):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").split()
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    links = {d: set() for d in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    cls = {}
    for d in ids:
        if d not in cls:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in cls:
                    cls[x] = d
                    todo += links[x]
    return {d: (cls[d], len(links[d])) for d in ids}


def near_rows():
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    base = fixtures.prose(rng, 150, 10**6).split()
    for k in range(60):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((1000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1024, 20])
def test_links(spark, block):
    rows = near_rows()
    out = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == want
    assert sum(n for _, n in want.values()) > 300


def test_odd(spark):
    assert nearjoin.near_duplicates(fixtures.empty(spark)).count() == 0
    out = nearjoin.near_duplicates(fixtures.odd(spark)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out) == [("-3", "-3", 0), ("5", "5", 0), ("5", "5", 2), ("5", "5", 2), ("9", "5", 2), ("None", "None", 0), ("None", "None", 0)]


def test_bounds_keep_true_pairs():
    rng = np.random.default_rng(3)
    steps = list(range(16, 97, 16))
    least = nearjoin.keep_from(0.8, 1e-6, steps)
    equal = rng.random((20000, 96)) < 0.8
    assert all((equal[:, :n].sum(1) >= m).all() for n, m in zip(steps, least, strict=True))
    assert least[-1] > 50


def test_one_of_each(spark):
    rows = near_rows()
    kept = nearjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(rows).values()})


def test_ranges_of_hashes_and_small_tables_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2))[:200] for _ in range(6)]
    sets = [np.union1d(sets[k % 6], sets[(k * 5 + 1) % 6][: k * 3]) for k in range(40)]
    i, j = np.triu_indices(40, 1)
    exact = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    for hashes in (1 << 20, 64):
        monkeypatch.setattr(nearjoin, "HASHES", hashes)
        assert nearjoin.intersections(sets, i, j).tolist() == exact
        assert len(nearjoin.forest(40, i, j)) == 39
    monkeypatch.setattr(nearjoin, "PAIRS", 30)
    keys = np.repeat(np.arange(9), [1, 2, 3, 9, 1, 1, 5, 2, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], ["k"]) for part in np.array_split(keys, 5)]
    for rows in (1, 4, 100):
        seen = [table.slice(a, b - a).column("k").to_pylist() for table, runs in nearjoin.whole_groups(batches, ["k"], rows) for a, b in runs]
        assert seen == [[k] * n for k, n in enumerate([1, 2, 3, 9, 1, 1, 5, 2, 4])]
