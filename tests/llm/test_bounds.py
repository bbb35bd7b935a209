"""Short benchmark items, blocks of a benchmark, very long texts and templates, and rows that repeat very often."""

import random

from tests.llm import fixtures
from tracewright.llm import decontamination, licenses, sharding, tokencounts, toxicity


def pairs(spark, docs, items, **options):
    out = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r.doc_id, r.item_id, r.edits) for r in out.collect()}


def test_short_items_match_whole(spark):
    items = [(1, "What is the capital of old Assyria?"), (2, "2+2"), (3, "cat"), (4, "  "), (5, None), (6, "Cat")]
    docs = [(1, "so: what is the\ncapital of OLD assyria? yes"), (2, "a 2+2 b"), (3, "concatenate"), (4, "the cat."), (5, "what is the capital of new assyria?"), (6, "12+2")]
    assert pairs(spark, docs, items) == {(1, 1, 0), (2, 2, 0), (4, 3, 0), (4, 6, 0)}
    left = decontamination.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6]


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, fixtures.prose(rng, 40, 10**6)) for k in range(12)]
    docs = [(k, fixtures.prose(rng, 50, 10**6) + " " + items[k % 12][1] + " " + fixtures.prose(rng, 50, 10**6)) for k in range(30)]
    want = {(k, k % 12, 0) for k in range(30)}
    assert pairs(spark, docs, items) == want
    assert pairs(spark, docs, items, block_bytes=900) == want
    monkeypatch.setattr(decontamination, "CHUNK", 97)
    index = decontamination.Index(items, 0.08, 96, 40)
    for k, text in docs:
        assert {item for (_, item), _ in decontamination.best_matches(index, [text]).items()} == {k % 12}


def test_a_long_template_finds_itself(spark):
    rng = random.Random(6)
    long = "\n".join(fixtures.prose(rng, 12, 10**6) for _ in range(40))
    head = fixtures.prose(rng, 500, 10**6)
    docs = [(0, long), (1, f"{head}\n{long}\n{head}"), (2, head), (3, " ".join(long.split()[:300]))]
    out = licenses.scanned(spark.createDataFrame(docs, "doc_id long, text string"), templates=[("long", long), ("short", "released under the mit license")])
    got = {r.doc_id: (r.labels, r.score, r.blocks) for r in out.collect()}
    assert got[0][:2] == ("long", 1.0) and got[1][:2] == ("long", 1.0)
    assert got[2] == ("", 0.0, []) and got[3][0] == ""
    assert any(b.first <= 500 and b.first + b.words >= 980 for b in got[1][2])


def test_rows_that_repeat_often_are_scattered(spark):
    rows = [(7, "x" * 50)] * 3000 + [(k, f"text {k}") for k in range(200)] + [(None, None)] * 1500
    out = sharding.shuffled_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, bucket_bytes=16_000)
    got = out.collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({(r.shard, r.bucket) for r in got if r.doc_id == 7}) > 5
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_memories_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokencounts, "MEMO_BYTES", 2000)
    counter = tokencounts.Counter([("▁a", -1.0), ("b", -2.0)])
    want = [counter.counts([t])[0] for t in ("a b ab", "ab a", "b" * 500)]
    for _ in range(9):
        assert counter.counts(["a b ab", "ab a", "b" * 500]) == want
    assert counter.held < 4000
    monkeypatch.setattr(toxicity, "MEMO_BYTES", 2000)
    read = toxicity.Terms(["a", "b"])
    for k in range(50):
        assert read.numbers(f"a b w{k}") == [0, 1]
    assert read.held < 4000
