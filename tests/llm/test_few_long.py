"""Components of few very long texts, dealt into about as many blocks as they have members."""

import random

from tests.llm import fixtures
from tests.llm.test_nearjoin import brute
from tracewright.llm import nearjoin


def test_empty_blocks_count_no_link_twice(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "SHINGLES", 100)
    rng, rows = random.Random(5), []
    for c in range(24):
        base = fixtures.prose(rng, 150, 10**6).split()
        for k in range(2 + c % 3):
            w = list(base)
            w[k * 7] = f"x{c}y{k}"
            rows.append((10 * c + k, " ".join(w)))
    out = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == brute(rows)
