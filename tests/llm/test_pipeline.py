"""The stages of the corpus pipeline on documents of known kinds, against brute force."""

import random

import corpus_pipeline
from tests.llm import fixtures
from tests.llm.test_nearjoin import brute
from tests.llm.test_texts import brute_substring
from tracewright.llm import decontamination


def corpus():
    rng = random.Random(21)
    docs, bench = [], [(k, fixtures.prose(rng, 30, 10**6)) for k in range(5)]
    passage = fixtures.prose(rng, 70, 10**6)
    for k in range(300):
        w = fixtures.prose(rng, 80, 10**6)
        if k % 10 == 1:
            w = "awful nasty " + w + " vile"
        if k % 10 == 2 and k > 10:
            w = docs[k - 10][1] + " more"
        if k % 10 == 3:
            w += " " + bench[k % 5][1]
        if k % 10 == 4:
            w += "\n" + passage
        docs.append((k, w, "en", "s", len(w)))
    return docs, bench


def test_stages(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, fixtures.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 1)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, str(tmp_path))
        if name == "toxicity":
            rows = {k: t for k, t in rows.items() if k % 10 != 1}
        elif name == "near_duplicates":
            rows = {k: rows[k] for k in {c for c, _ in brute(list(rows.items())).values()}}
        elif name == "substring_dedup":
            removed = brute_substring(list(rows.items()), 50)
            assert {r.doc_id: len((r.text or "").split()) for r in got.collect()} == {k: n - m for k, (n, m, _) in removed.items() if not n or m < n}
            rows = {r.doc_id: r.text for r in got.collect()}
            assert all(r.n_chars == len(r.text) for r in got.collect())
        elif name == "decontamination":
            index = decontamination.Index(bench, 0.08, 96, 40)
            rows = {k: t for k, t in rows.items() if not any(s in decontamination.folded(t) for _, s, _, _ in index.segments)}
        if name != "packing":
            assert got.columns == corpus_pipeline.COLUMNS
            assert {r.doc_id: r.text for r in got.collect()} == rows, name
    out = got.collect()
    assert sorted({r.doc_id for r in out}) == sorted(rows)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.ids_crc32) for r in out}
