"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bytebpe, decontamination, divergence, lexical, licenses, nearjoin, packing, quality, sharding, sstable, substring, tokencounts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    shards = sharding.shuffled_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sstable(spark, sf_dir):
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return sstable.read_tables(sstable.write_tables(table(spark, sf_dir, "documents"), vocab, end_id=2))


def op4_ngram_jaccard(spark, sf_dir):
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    out = substring.deduplicated(table(spark, sf_dir, "documents"), window=50)
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents")).select("doc_id", *licenses.ADDED)


def op7_quality(spark, sf_dir):
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "score")


def op8_token_counts(spark, sf_dir):
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark, sf_dir):
    vocab = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(table(spark, sf_dir, "documents"), vocab, capacity=4096, end_id=1, with_ids=False)


def op11_ranked_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bytebpe.decoded(bytebpe.encoded(table(spark, sf_dir, "documents"), ranks), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"), least_docs=30, top_terms=50)


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_decontamination, op3_sstable, op4_ngram_jaccard, op5_substring_dedup, op6_license_scan, op7_quality, op8_token_counts, op9_toxicity, op10_packing, op11_ranked_search, op12_byte_bpe, op13_source_divergence)
}
FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Of the others none: hashing, tokenizers, learned models and links between texts are tested against brute force instead.
ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id), s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, big_n),
i AS (SELECT doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS x FROM t JOIN d USING (doc_id) JOIN w ON w.term = t.term, s),
c AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN i ON i.term = q.term GROUP BY item_id, doc_id HAVING sum(x) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c)
SELECT * FROM r WHERE rank <= 20""",
    "op13_source_divergence": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, lang, source, unnest(regexp_extract_all({FOLD}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM u GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT g.lang, g.source, (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS own, (SELECT coalesce(sum(ln), 0) FROM k WHERE k.lang = g.lang) AS whole FROM g),
p AS (SELECT v.lang, v.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * CAST(coalesce(n, 0) + 5 AS HUGEINT)) // (own + 5 * v) AS p, 1 + (1000000000 * CAST(ln + 5 AS HUGEINT)) // (whole + 5 * v) AS q
 FROM v JOIN k ON k.lang = v.lang LEFT JOIN c ON c.lang = v.lang AND c.source = v.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
}
