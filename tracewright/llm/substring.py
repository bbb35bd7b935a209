"""Substring dedup: passages of `window` words that an earlier document also has are cut out.

Fixed-block anchors: every document is indexed by its non-overlapping blocks of window / 2 words, and every rolling run
of that many words of every document probes the index. A passage of `window` words holds a whole block of the document
that it also stands in, so each repeat is hit; only hits between different documents count. Hits then grow to maximal
exact repeats: the windows around a hit meet by hash, the smallest doc_id of each window's documents goes back, and the
windows that start in a smaller doc_id cover, together, the whole of each repeat.

Nothing is matched in pairs. Documents are kept in batches, a table bucketed by batch. A batch sends each distinct hash
once, as sorted differences packed in columns of bytes, to the range of hashes it belongs to, and gets back what is
shared; so a passage that a third of all documents share costs one entry for each batch. Probes are cut to as many bits
as keep false hits rare (they cost work, no results). Windows around hits meet by two independent hashes of their word
sequence, 96 bits together: among n different windows two agree with probability n * n / 2^97, 6e-6 for 10^12.

Defined results: null and empty texts have no words; documents shorter than a window stay; rows that share a doc_id
don't remove each other's words; rows with a null doc_id stay whole and remove nothing. Text that loses nothing is
returned unchanged, else its kept words with the space after each. Input columns named n_words or n_removed become
in_<name>; all others pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import parts_for, rolling, shared_dir, total_bytes, unclash, word_hashes, words, worker_cache, written

NO_DOC = np.iinfo(np.int64).max
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def squeeze(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers: their differences, byte by byte in columns, compressed."""
    d = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1).cumsum(dtype=np.uint64)


def plain(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unplain(data: bytes, dtype) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def ranges_of(x: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the runs of a sorted array whose values agree but for their last `shift` bits."""
    if not len(x):
        return []
    lead = x >> np.uint64(shift) if shift < 64 else np.zeros(len(x), np.uint64)
    at = np.flatnonzero(np.diff(lead, prepend=~lead[:1])).tolist()
    return [(int(lead[a]), a, b) for a, b in zip(at, [*at[1:], len(x)], strict=True)]


def between(x: np.ndarray, lead: int, shift: int) -> np.ndarray:
    """The part of a sorted array that lies in a range."""
    if shift >= 64:
        return x
    low, high = np.searchsorted(x >> np.uint64(shift), np.asarray([lead, lead + 1], np.uint64))
    return x[low:high]


def second_windows(text: str | None, window: int) -> np.ndarray:
    """32 bits for each window, from hashes of words that are independent of the first ones."""
    w = words(text)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x, 0x5851F42D4C957F2D) for x in w), np.uint64, len(w))
    return (rolling(h, window) >> np.uint64(32)).astype(np.uint32)


def opened(blob: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(blob)))


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    return [word_hashes(words(t)) for t in texts]


def firsts_of(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (x, y) in order, with the least and the greatest d of each."""
    order = np.lexsort((d, y, x))
    x, y, d = x[order], y[order], d[order]
    first = np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(y, prepend=~y[:1]) != 0))
    last = np.append(first[1:], len(x)) - 1
    return x[first], y[first], d[first], d[last]


def place_of(x: np.ndarray, y: np.ndarray, own: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where each pair (own, second) is among the sorted pairs (x, y), -1 where it isn't."""
    at = np.minimum(np.searchsorted(x, own), len(x) - 1)
    while True:  # steps on only where two different windows share the first hash
        on = (x[at] == own) & (y[at] != second) & (at + 1 < len(x))
        if not on.any():
            return np.where((x[at] == own) & (y[at] == second), at, -1)
        at[on] += 1


def batched(docs: DataFrame, batch_bytes: int, n: int) -> DataFrame:
    """The documents as a table of batches, bucketed by batch so that joins on it don't move them again."""
    spark = docs.sparkSession

    def pack(rows):
        worker_cache("substring")
        k, part = 0, TaskContext.get().partitionId()
        for batch in rows:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(sizes.cumsum() // batch_bytes, prepend=0))
            for a, b in zip([0, *cut], [*cut, len(sizes)], strict=True):
                if b > a:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_pydict({"batch": [part << 32 | k], "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                    k += 1

    name = f"tracewright_batches_{uuid.uuid4().hex}"
    docs.mapInArrow(pack, "batch long, blob binary").write.bucketBy(n, "batch").option("path", shared_dir(spark)).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def deduplicated(docs: DataFrame, *, window: int = 50, batch_bytes: int = 8_000_000, range_words: int = 2_000_000) -> DataFrame:
    """docs with repeated passages cut out of text, plus n_words (before) and n_removed."""
    docs = unclash(docs, ["n_words", "n_removed"])
    spark, anchor = docs.sparkSession, window // 2
    n_bytes = total_bytes(docs)
    most_words = max(2, n_bytes // 2 + 1)
    range_bits = max(0, math.ceil(math.log2(max(1, n_bytes / 6 / range_words))))
    keep = min(64, max(range_bits + 8, math.ceil(math.log2(most_words)) + 12))
    drop = np.uint64(64 - keep)
    packed = batched(docs, batch_bytes, parts_for(n_bytes, 4 * batch_bytes, least=2))
    def probe(rows):
        worker_cache("substring")
        for batch in rows:
            for number, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                runs, blocks = [], []
                for h in hashed(opened(blob).column("text").to_pylist()):
                    r = rolling(h, anchor) >> drop
                    blocks.append(r[::anchor])
                    runs.append(np.unique(r))
                x, counts = np.unique(np.concatenate([*runs, np.empty(0, np.uint64)]), return_counts=True)
                several, index = x[counts > 1], np.unique(np.concatenate([*blocks, np.empty(0, np.uint64)]))
                shift = keep - range_bits
                out = [(r, number, squeeze(x[a:b]), squeeze(between(several, r, shift)), squeeze(between(index, r, shift))) for r, a, b in ranges_of(x, shift)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "batch", "runs", "several", "blocks"])

    def meet(pdf):
        import pandas as pd

        runs = [unsqueeze(b) for b in pdf["runs"]]
        x = np.sort(np.concatenate(runs))
        shared = np.union1d(x[1:][x[1:] == x[:-1]], np.concatenate([unsqueeze(b) for b in pdf["several"]]))
        index = np.unique(np.concatenate([unsqueeze(b) for b in pdf["blocks"]]))
        hits = shared[within(shared, index)]
        found = [(n, squeeze(own)) for n, r in zip(pdf["batch"], runs, strict=True) if len(own := r[within(r, hits)])]
        return pd.DataFrame(found, columns=["batch", "hits"])

    probes = packed.mapInArrow(probe, "range int, batch long, runs binary, several binary, blocks binary")
    hits = probes.groupBy("range").applyInPandas(meet, "batch long, hits binary").groupBy("batch").agg(F.collect_list("hits").alias("hits"))

    def around(h: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a run that was hit."""
        if len(h) < window:
            return np.empty(0, np.int64)
        at = np.flatnonzero(within(rolling(h, anchor) >> drop, hits))
        steps = np.zeros(len(h) + 2, np.int64)
        np.add.at(steps, np.maximum(0, at - (window - anchor)), 1)
        np.add.at(steps, at + 1, -1)
        return np.flatnonzero(steps.cumsum()[: len(h) - window + 1] > 0)

    def grow(rows):
        worker_cache("substring")
        for batch in rows:
            for number, blob, replies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                known, hashes, seconds, owners = np.sort(np.concatenate([unsqueeze(b) for b in replies])), [], [], []
                table = opened(blob)
                texts = table.column("text").to_pylist()
                for doc_id, text, h in zip(table.column("doc_id").to_pylist(), texts, hashed(texts), strict=True):
                    if doc_id is not None and len(s := around(h, known)):
                        hashes.append(rolling(h, window)[s])
                        seconds.append(second_windows(text, window)[s])
                        owners.append(np.full(len(s), doc_id, np.int64))
                if not hashes:
                    continue
                x, y, least, most = firsts_of(np.concatenate(hashes), np.concatenate(seconds), np.concatenate(owners))
                several = (most > least).astype(np.uint8)
                out = [(r, number, squeeze(x[a:b]), plain(y[a:b]), plain(least[a:b]), plain(several[a:b])) for r, a, b in ranges_of(x, 64 - range_bits)]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "batch", "x", "y", "least", "several"])

    windows = packed.join(hits, "batch").select("batch", "blob", "hits").mapInArrow(grow, "range int, batch long, x binary, y binary, least binary, several binary")

    def earliest(pdf):
        import pandas as pd

        xs, ys, least = [unsqueeze(b) for b in pdf["x"]], [unplain(b, np.uint32) for b in pdf["y"]], [unplain(b, np.int64) for b in pdf["least"]]
        x, y, d, _ = firsts_of(np.concatenate(xs), np.concatenate(ys), np.concatenate(least))
        out = []
        for number, own, second, low, several in zip(pdf["batch"], xs, ys, least, pdf["several"], strict=True):
            best = d[place_of(x, y, own, second)]
            tell = (best < low) | (unplain(several, np.uint8) > 0)
            if tell.any():
                out.append((number, squeeze(own[tell]), plain(second[tell]), plain(best[tell])))
        return pd.DataFrame(out, columns=["batch", "x", "y", "least"])

    found = windows.groupBy("range").applyInPandas(earliest, "batch long, x binary, y binary, least binary")
    firsts = written(found.groupBy("batch").agg(*[F.collect_list(c).alias(c) for c in ("x", "y", "least")]), compression="none")

    def cut(rows):
        worker_cache("substring")
        for batch in rows:
            for blob, xs, ys, leasts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                table = opened(blob)
                texts, n_words, n_removed = table.column("text").to_pylist(), [], []
                if xs:
                    parts = [unsqueeze(b) for b in xs], [unplain(b, np.uint32) for b in ys], [unplain(b, np.int64) for b in leasts]
                    x, y, d, _ = firsts_of(*map(np.concatenate, parts))
                for i, (doc_id, text) in enumerate(zip(table.column("doc_id").to_pylist(), texts, strict=True)):
                    tokens = words(text)
                    n_words.append(len(tokens))
                    n_removed.append(0)
                    if not xs or doc_id is None or len(tokens) < window:
                        continue
                    w = rolling(word_hashes(tokens), window)
                    starts = np.flatnonzero(within(w, x))
                    if len(starts):
                        at = place_of(x, y, w[starts], second_windows(text, window)[starts])
                        starts = starts[(at >= 0) & (d[at] < doc_id)]
                    if len(starts):
                        steps = np.zeros(len(tokens) + 1, np.int64)
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + window, -1)
                        gone = steps.cumsum()[:-1] > 0
                        n_removed[-1] = int(gone.sum())
                        raw = text.encode("utf-8", "surrogatepass")
                        at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
                        texts[i] = b"".join(raw[at[k] : at[k + 1]] for k in np.flatnonzero(~gone)).decode("utf-8", "surrogatepass").rstrip(" \t\n\r\x0b\x0c")
                table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, table.schema.field("text").type))
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*table.schema.names, "n_words", "n_removed"])

    schema = StructType([*docs.schema, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return packed.join(firsts, "batch", "left").select("blob", "x", "y", "least").mapInArrow(cut, schema)
