"""The encoder's memory is bounded in bytes, and ids that don't fit their width are errors."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import fixtures
from tracewright.llm import encoding, packing, sstable

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]


@pytest.mark.parametrize("path", FILES)
def test_memory_starts_anew(path, monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_BYTES", 20_000)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["w", "Über", "don't", "x" * 300, "a.b,", "end.\nNext", "q***", "A\u0301b!"]) + str(rng.randrange(50)) * rng.randrange(2) for _ in range(80)) for _ in range(60)]
    own, whole = encoding.Encoder(path), Tokenizer.from_file(path)
    for at in range(0, 60, 5):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts[at : at + 5])]
        assert got == [e.ids for e in whole.encode_batch(texts[at : at + 5], add_special_tokens=False)]
        assert own.held < 20_000 + 60_000


def test_narrow():
    assert encoding.narrow(np.asarray([0, 65535], np.uint32), 2).dtype.itemsize == 2
    with pytest.raises(ValueError):
        encoding.narrow(np.asarray([70000], np.uint32), 2)


def test_wide_ids_are_errors(spark):
    docs = fixtures.docs(spark)
    with pytest.raises(Exception, match="more than 1 bytes"):
        sstable.write_tables(docs, FILES[0], id_width=1).count()
    with pytest.raises(Exception, match="more than 1 bytes"):
        packing.packed(docs, FILES[1], id_width=1).count()


def test_starts_over_runs_of_files(spark, monkeypatch):
    monkeypatch.setattr(sstable, "FILES_A_RUN", 3)
    out = sstable.read_tables(sstable.write_tables(fixtures.docs(spark), FILES[0], shard_bytes=4000)).orderBy("doc_id").collect()
    starts = np.cumsum([0, *[r.n_tokens for r in out]])
    assert [r.start for r in out] == starts[:-1].tolist()
