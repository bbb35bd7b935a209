"""Packing sends a worker few rows at once and keeps few units, whatever the session and the texts are."""

import public_tokenizers
import pyarrow as pa

from tracewright.llm import encoding, packing
from tracewright.llm.common import BATCH_ROWS, written


def test_batches_of_one_write(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(BATCH_ROWS)
    found = written(spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long"), batch_rows=1000).collect()
    assert sorted(r["n"] for r in found) == [500, 1000, 1000]
    assert spark.conf.get(BATCH_ROWS) == before


def test_pieces_come_in_small_batches(spark, monkeypatch):
    real = packing.batches

    def small(texts, chars):
        assert len(texts) <= 1000
        return real(texts, chars)

    monkeypatch.setattr(packing, "batches", small)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id doc_id", "concat('word', id) text")
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2500))


def test_memory_of_units_is_bounded():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, free = encoding.Encoder(path, memo=100_000), encoding.Encoder(path)
    for k in range(20):
        texts = [" ".join(f"unit{k * 500 + i}x" for i in range(500))]
        assert own.ids(texts) == free.ids(texts)
        assert own.held < 100_000 + 500 * 300
    assert free.held > 1_000_000
