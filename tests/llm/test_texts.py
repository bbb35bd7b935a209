"""Sharding, sorted tables, substring dedup and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import fixtures
from tracewright.llm import packing, sharding, sstable, substring
from tracewright.llm.common import STEP, mixed, rolling, word_hashes
from tracewright.llm.encoding import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_whole_texts(path):
    rng = random.Random(3)
    alphabet = [" ", "\n", "a", "b'", "s", "1", "é", " ", "!", "\t", " ", "ß", "'ll", "́", "word", ".", ","]
    texts = ["", " ", "a  b", "a\n\nb c", "<|endoftext|> a", *["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000)]]
    own = Encoder(path).ids(texts)
    whole = tokenizer(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [e.ids for e in whole]


def test_rolling_hash():
    h = word_hashes([str(i).encode() for i in range(90)])
    for n in (1, 2, 5, 25, 50):
        plain = [sum(int(x) * pow(STEP, n - 1 - k, 1 << 64) for k, x in enumerate(h[i : i + n])) % (1 << 64) for i in range(90 - n + 1)]
        with np.errstate(over="ignore"):
            assert (rolling(h, n) == mixed(np.asarray(plain, np.uint64))).all()


def test_shards(spark):
    rows = fixtures.rows()
    out = sharding.shuffled_shards(fixtures.docs(spark), 8, bucket_bytes=2000).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text is not None) == sorted((r[0], r[1]) for r in rows if r[1] is not None)
    slots = defaultdict(list)
    for r in out:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shuffled_shards(fixtures.docs(spark).limit(30), 8).collect()}
    assert all({r.doc_id: r.shard for r in out}[k] == v for k, v in again.items())
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def test_shards_odd(spark):
    assert sharding.shuffled_shards(fixtures.empty(spark)).count() == 0
    out = sharding.shuffled_shards(fixtures.odd(spark), 3)
    assert out.count() == 7 and {r.in_shard for r in out.collect()} == {"mine"}


def expected_tokens(rows, path, end):
    tk, start, out = tokenizer(path), 0, []
    for doc_id, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_sorted_tables(spark):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    manifest = sstable.write_tables(fixtures.docs(spark).orderBy("text"), BYTES, shard_bytes=8000, block_bytes=500)
    got = sorted(tuple(r) for r in sstable.read_tables(manifest).collect())
    assert got == expected_tokens(rows, BYTES, 2)
    assert manifest.count() > 3
    tables = [sstable.Reader(r.path) for r in manifest.collect()]
    tk = tokenizer(BYTES)
    for doc_id, text in rows[::7]:
        found = [v.tolist() for t in tables for v in t.get(doc_id)]
        assert found == [[*tk.encode(text or "", add_special_tokens=False).ids, 2]]
    assert not [v for t in tables for v in t.get(10**6)]


def test_sorted_tables_odd(spark):
    assert sstable.read_tables(sstable.write_tables(fixtures.empty(spark), BYTES)).count() == 0
    manifest = sstable.write_tables(fixtures.odd(spark), BYTES, shard_bytes=100)
    out = sstable.read_tables(manifest).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, -3, 5, 5, 5, 9]
    assert sum(len(sstable.Reader(r.path).get(5)) for r in manifest.collect()) == 3
    assert sum(len(sstable.Reader(r.path).get(None)) for r in manifest.collect()) == 2


def brute_substring(rows, window):
    first = {}
    tokens = {}
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        tokens[doc_id] = w
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = {}
    for doc_id, w in tokens.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batch_bytes,range_words", [(8_000_000, 2_000_000), (3000, 500)])
def test_substring(spark, batch_bytes, range_words):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    out = substring.deduplicated(fixtures.docs(spark), window=50, batch_bytes=batch_bytes, range_words=range_words).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out}
    want = brute_substring(rows, 50)
    assert got == want and sum(v[1] for v in want.values()) > 500
    unchanged = dict(rows)
    assert all(r.text == unchanged[r.doc_id] for r in out if not r.n_removed)


def test_substring_odd(spark):
    assert substring.deduplicated(fixtures.empty(spark)).count() == 0
    out = substring.deduplicated(fixtures.odd(spark)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_removed) for r in out) == [(-99, 0), (-99, 0), (-3, 0), (5, 0), (5, 0), (5, 0), (9, 120)]
    assert {r.in_n_words for r in out} == {"mine"}


def test_packing(spark):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    tk = tokenizer(WORDS)
    want = {}
    for doc_id, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            want[doc_id, k] = (at, ids[at : at + 512])
    out = packing.packed(fixtures.docs(spark), WORDS, capacity=512).collect()
    assert {(r.doc_id, r.piece): (r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in out} == want
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(want[r.doc_id, r.piece][1], "<u4").tobytes()) and r.length == len(want[r.doc_id, r.piece][1]) for r in out)
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(len(ids) for _, ids in want.values())
    assert len(used) <= -(-total // 512) + 1


def test_packing_odd(spark):
    assert packing.packed(fixtures.empty(spark), WORDS).count() == 0
    out = packing.packed(fixtures.odd(spark), WORDS).collect()
    assert len(out) == 7 and len({r.sequence_id for r in out}) == 1


def least_bins(lengths, capacity):
    """By trying every assignment."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_packing_near_the_optimum():
    rng = random.Random(5)
    off = 0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 10) for _ in range(9)), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        fillings = packing.plan(counts, 10)
        assert all(sum(f) <= 10 for f, _ in fillings)
        assert sorted(n for f, t in fillings for n in f * t) == sorted(lengths)
        off += sum(t for _, t in fillings) - least_bins(lengths, 10)
    assert off <= 2
