"""Ranked search, byte-level BPE and the divergence audit against brute force, the library and odd tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import fixtures
from tracewright.llm import bytebpe, divergence, lexical, queries, terms

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text, pattern):
    return [t.translate(FOLD) for t in re.findall(pattern, text or "")]


def brute_search(docs, items, k=20):
    words = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    own = [(d, Counter(w), len(w)) for d, t in docs if (w := split(t, words))]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, scored = split(text, words), []
        for d, c, n in own:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def told(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_search_on_odd_rows(spark):
    docs = [*[(r[0], r[1]) for r in fixtures.rows()], (None, "w1 w2 w3"), (None, "w1 w2 w3"), (4, "w1 w2 w3"), (4, "w1 w2 w3"), (-9, "w1 w2 w3"), (70, "é Straße STRASSE " * 3000)]
    items = [(1, "w1 w2 w2 w3"), (1, "W1"), (2, None), (3, ""), (4, "never there"), (None, "é straße w7 " * 5), (6, "-- !"), (7, "w%d " * 3 % (5, 6, 5))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS _item").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS score")
    for k in (1, 3, 20):
        assert told(lexical.ranked(frame, asked, k=k).collect()) == brute_search(docs, items, k)
    assert lexical.ranked(fixtures.empty(spark), asked).collect() == []
    assert lexical.ranked(frame, asked.limit(0)).collect() == []


def test_search_in_blocks_and_branches(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("BRANCH_TERMS", 20), ("BRANCH_ITEMS", 5), ("CELLS", 400)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    docs = [(k, fixtures.prose(rng, rng.randrange(40), 30)) for k in range(120)]
    items = [(k, fixtures.prose(rng, rng.randrange(1, 12), 30)) for k in range(40)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert told(got.collect()) == brute_search(docs, items, 4)


def test_pairs_of_nodes_are_left_out():
    """Items and documents of sixteen subjects, a node of documents each: most pairs are never met."""
    rng = np.random.default_rng(1)
    counts = [{int(t): 1 for t in rng.choice(25, 8, False) + 25 * (k % 16)} for k in range(64)]
    tree = lexical.Branch(list(range(64)), counts, np.ones(400, np.int64), np.ones(400))
    docs = np.zeros((1024, 400))
    for k in range(16):
        docs[64 * k : 64 * k + 64, 25 * k : 25 * k + 25] = rng.integers(0, 2, (64, 25))
    docs = docs[:, tree.columns >= 0][:, np.argsort(tree.columns[tree.columns >= 0])]
    whole = tree.levels[-1] @ docs.T
    floor = np.sort(whole, 1)[:, -20].astype(np.int64)
    alive, scores, work = lexical.met(tree, docs, np.maximum(floor, 1))
    assert (alive == (whole >= np.maximum(floor, 1)[:, None])).all() and (scores[alive] == whole[alive]).all()
    assert work < 64 * 1024 / 2


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same_ids(coder, library, texts):
    ids, n = coder.ids(texts)
    edges = np.concatenate([[0], n.cumsum()])
    for k, t in enumerate(texts):
        assert ids[edges[k] : edges[k + 1]].tolist() == library.encode_ordinary(t), repr(t[:80])


def test_ids_equal_the_library(library):
    coder, rng = bytebpe.Coder(RANKS), random.Random(5)
    parts = ["a", "B", "'", "'s", "'ll", "'re", "'ve", "'l", "'d", "'t", "'m", " ", "  ", "\n", "\t", "\r", "1", "²", "é", "日", "!", "?", " ", "　", "\x1c", "\x85", "​", "\U0001f600", "é", "<|endoftext|>", "\x00"]
    same_ids(coder, library, ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)])
    same_ids(coder, library, [f"x{c}y 1{c} {c}2" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)][::37])])
    for size in (2, 3, 100, 1023, 1024, 1025, 5000):
        same_ids(coder, library, ["".join(rng.choice("aeth") for _ in range(size)), "-" * size, " " * size, "日" * size])
    same_ids(coder, library, [])


def test_memory_begins_anew_and_texts_are_cut(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO_BYTES", 3000)
    monkeypatch.setattr(bytebpe, "PIECE", 50)
    coder, rng = bytebpe.Coder(RANKS), random.Random(6)
    text = "".join(rng.choice(["word", "don't", " ", "  ", "\n", "\n\n", "x1", ",", " \t", "é"]) for _ in range(4000))
    assert "".join(bytebpe.pieces(text)) == text and len(list(bytebpe.pieces(text))) > 20
    got = np.concatenate([coder.ids(some)[0] for _, some in bytebpe.groups([text])])
    assert got.tolist() == library.encode_ordinary(text)
    assert list(bytebpe.pieces("x" * 500)) == ["x" * 500] and list(bytebpe.pieces("")) == [""]


def test_encoding_and_decoding_on_odd_rows(spark, library):
    texts = [(1, None), (1, None), (None, ""), (2, "a'll b  \n"), (3, "é\x00\U0001f600 <|endoftext|>"), (4, "long " * 60000), (4, "long " * 60000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'mine' AS ids", "'mine' AS raw")
    got = bytebpe.decoded(bytebpe.encoded(frame, RANKS), RANKS).collect()
    want = Counter((d, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for d, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["raw"])) for r in got) == want
    assert bytebpe.decoded(bytebpe.encoded(fixtures.empty(spark), RANKS), RANKS).collect() == []
    wrong = spark.createDataFrame([(1, b"a\xffb")], "doc_id long, raw_text binary").selectExpr("doc_id", "cast(raw_text as string) AS text")
    assert bytes(bytebpe.decoded(bytebpe.encoded(wrong, RANKS), RANKS).first()["raw"]).decode() == "a�b"


def test_op12(spark, library):
    import pandas as pd

    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    assert len(got) == len(d)
    for doc_id, text in zip(d.doc_id, d.text, strict=True):
        ids, r = library.encode_ordinary(text or ""), got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def brute_divergence(docs, least, most):
    counts, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = split(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
        counts[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    share = lambda n, total: 1 + (10**9 * (n + 5)) // total
    for lang in langs:
        kept = sorted(t for t in held[lang] if held[lang][t] >= least)
        total = {s: sum(c[t] for t in kept) + 5 * len(kept) for (x, s), c in counts.items() if x == lang}
        whole = sum(langs[lang][t] for t in kept) + 5 * len(kept)
        for s in total:
            own = {t: share(counts[lang, s][t], total[s]) for t in kept}
            far = [(-sum(abs(own[t] - share(counts[lang, q][t], total[q])) for t in kept), q.encode(), q) for q in total if q != s]
            apart = [(share(langs[lang][t], whole) - own[t], t.encode(), t) for t in kept if counts[lang, s][t] and own[t] > share(langs[lang][t], whole)]
            for part, rows in (("pair", sorted(far)), ("term", sorted(apart)[:most])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile"), [(4096, 64), (7, 2)])
def test_divergence_on_odd_rows(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(11)
    docs = [(fixtures.prose(rng, rng.randrange(60), 40).replace("w1", "Wort ").replace("w2", "é"), rng.choice(["en", "de", None, ""]), f"s{rng.randrange(6)}") for _ in range(200)]
    docs += [(None, "fr", "a"), ("", "fr", "b"), ("seul", "fr", None), ("12 -- 34", "en", "bare"), ("w " * 50000, "en", "s1"), docs[0], docs[0]]
    frame = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS value").repartition(3)
    got = divergence.audited(frame, least_docs=3, top_terms=5, block=block, tile=tile).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == brute_divergence(docs, 3, 5)
    assert divergence.audited(fixtures.empty(spark)).collect() == []


def test_equal_subtrees_are_one_node():
    rows = np.zeros((3, 1000), np.int64)
    rows[:, :4] = [[1, 2, 3, 4], [1, 2, 0, 0], [5, 5, 5, 5]]
    forest = divergence.Forest(rows)
    assert sum(len(left) for left, _ in forest.levels) < 60  # of 3 * 1023
    totals = np.asarray([5010, 5003, 5020])
    want = [sum(abs((1 + 10**9 * (int(x) + 5) // int(totals[i])) - (1 + 10**9 * (int(y) + 5) // int(totals[j]))) for x, y in zip(rows[i], rows[j], strict=True)) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert forest.distances(np.asarray([0, 0, 1]), np.asarray([1, 2, 2]), totals).tolist() == want
    big = np.asarray([2**50, 0, 7])
    assert divergence.shares(big, np.asarray([2**51, 3 * 2**50, 12])).tolist() == [1 + 10**9 * (int(n) + 5) // t for n, t in zip(big, (2**51, 3 * 2**50, 12), strict=True)]


def test_terms_are_cut_between_terms():
    raw = ("Ab3 cd-É9 " * 50).encode()
    for digits, pattern in ((True, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (False, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        got = [t.decode() for part in terms.term_lists(raw, terms.folding(digits=digits), piece=13) for t in part]
        assert got == split(raw.decode(), pattern)
    assert list(terms.term_lists(None, terms.folding(digits=True))) == []
