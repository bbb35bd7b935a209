"""The corpus pipeline on odd tables: null ids and texts, repeated rows, other columns, nothing at all."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import fixtures

LABELS = "doc_id long, quality int, toxic int"


def tables(spark, where, docs, bench, labels, schema=fixtures.SCHEMA):
    spark.createDataFrame(docs, schema).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, tmp_path, labelled):
    rng = random.Random(4)
    x, y = fixtures.prose(rng, 90, 10**6), fixtures.prose(rng, 90, 10**6)
    docs = [(None, x), (None, None), (1, None), (2, ""), (3, x), (3, x), (4, x), (5, y), (6, fixtures.prose(rng, 30_000, 10**6)), (7, None)]
    labels = [(3, 1, 0), (5, 1, 0), (None, 1, 1), (9, None, None)] if labelled else []
    tables(spark, tmp_path, [(d, t, "en", None, None, "mine") for d, t in docs], [(1, None), (None, "")], labels, fixtures.SCHEMA + ", score string")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {}
    for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        whole.setdefault((r.doc_id, r.ids if r.doc_id is None else None), []).extend(np.frombuffer(r.ids, "<u2").tolist())
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    texts = dict(docs)
    assert {d: v for (d, _), v in whole.items() if d is not None} == {d: ids(texts[d]) for d in (1, 2, 3, 5, 6, 7)}
    assert sorted(map(len, (v for (d, _), v in whole.items() if d is None))) == sorted([len(ids(None)), len(ids(x))])


def test_no_rows(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == corpus_pipeline.COLUMNS and got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
