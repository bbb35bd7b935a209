"""Toxicity with few labels: all examples and all their terms count."""

import random

from tests.llm import fixtures
from tracewright.llm import toxicity


def test_few_labels_and_opposite_copies(spark):
    rng = random.Random(3)
    docs = [(k, fixtures.prose(rng, 60, 3000) + (" scumword loserword" if k % 6 == 0 else "")) for k in range(80)]
    # Two copies of one text with other labels both stay examples.
    docs += [(1001, docs[1][1]), (1002, docs[1][1])]
    labels = [(k, int(k % 6 == 0)) for k in range(80)] + [(1001, 1), (1002, 0)]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored(frame, known).collect()
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert {r.predicted for r in held if r.doc_id % 6 == 0} == {1} and all(r.predicted == (r.doc_id % 6 == 0) for r in held)
    model = toxicity.fitted(frame, known, folds=5, max_rows=20_000, k=15)[0].value
    trained = {r.doc_id for r in out if not r.held_out}
    assert {d for d, _ in docs if d < 1000 and d != 1 and d in trained} <= set(model.index.ids.tolist())
    assert len({int(model.index.toxic[p]) for p, d in enumerate(model.index.ids) if d in (1, 1001, 1002)}) == len({dict(labels)[d] for d in (1, 1001, 1002) if d in trained})
