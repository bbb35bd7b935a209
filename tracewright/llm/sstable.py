"""Token-ID output as sorted-string-table shards: one file for each range of keys.

A file holds blocks of entries in key order, each key stored as the length it shares with the one before plus the rest,
each block compressed; then a sparse index (first key, place, entries of each block), a Bloom filter over the keys and a
fixed footer that says where they are. A lookup asks the filter, then searches the index by halves and reads one block.

    file   = block* index bloom footer
    block  = zstd(entry*)           entry = varint shared, varint rest, varint value bytes, rest of key, value
    index  = (u32 key length, key, u64 offset, u32 length, u32 entries)*
    footer = u64 index at, u64 index length, u64 bloom at, u64 bloom length, u64 entries, u64 ids, u32 id width, magic

Keys are 9 bytes that sort as the identifiers do (0 for null, else 1 and the signed 64-bit number with its sign bit
flipped). Values are token ids, each document's end id last, 2 or 4 bytes each.

Defined results: a null or empty text is the end id alone; a null identifier sorts first; rows that share an identifier
are all kept, ordered by the hash of their text, and a lookup returns them all; a run of them may go on in the next
file. An empty table gives no entries. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import parts_for, shared_dir, total_bytes, written
from tracewright.llm.encoding import batches, encoder, narrow

MAGIC = b"TWSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQI8s")
ENTRY = struct.Struct("<QII")
MANIFEST = "path string, first_key binary, part int, docs long, ids long, bytes long"
FILES_A_RUN = 4096
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def doc_id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int = 7) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Entries must come in key order."""

    def __init__(self, stream, id_width: int, block_bytes: int):
        self.stream, self.id_width, self.block_bytes = stream, id_width, block_bytes
        self.at = self.docs = self.ids = 0
        self.block, self.count, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.digests = [], []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def put(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.docs, self.ids, self.last = self.count + 1, self.docs + 1, self.ids + len(value) // self.id_width, key
        self.digests.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            data = self.zstd.compress(bytes(self.block))
            self.stream.write(data)
            self.index.append((self.first, self.at, len(data), self.count))
            self.at += len(data)
            self.block, self.count = bytearray(), 0

    def close(self) -> int:
        self._flush()
        index = b"".join(struct.pack("<I", len(k)) + k + ENTRY.pack(at, n, c) for k, at, n, c in self.index)
        bits = np.zeros(max(64, 10 * len(self.digests)) // 8 + 1, np.uint8)
        for key in self.digests:
            for p in _probes(key, len(bits) * 8):
                bits[p >> 3] |= 1 << (p & 7)
        bloom = bits.tobytes()
        self.stream.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.id_width, MAGIC))
        self.stream.close()
        return self.at + len(index) + len(bloom) + FOOTER.size


class Reader:
    def __init__(self, path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        index_at, index_len, self.bloom_at, self.bloom_len, self.docs, self.ids, self.id_width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no table of this format")
        raw, at, self.index = self.file.read_at(index_len, index_at), 0, []
        while at < len(raw):
            n = struct.unpack_from("<I", raw, at)[0]
            self.index.append((raw[at + 4 : at + 4 + n], *ENTRY.unpack_from(raw, at + 4 + n)))
            at += 4 + n + ENTRY.size
        self.bloom = self.file.read_at(self.bloom_len, self.bloom_at)

    def _block(self, at: int, length: int, entries: int) -> Iterator[tuple[bytes, bytes]]:
        data, pos, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at)), 0, b""
        for _ in range(entries):
            shared, pos = _read_varint(data, pos)
            rest, pos = _read_varint(data, pos)
            size, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            yield key, data[pos + rest : pos + rest + size]
            pos += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, length, entries in self.index:
            yield from self._block(at, length, entries)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        found = []
        for first, at, length, entries in self.index[max(0, bisect_left(self.index, (key,)) - 1) :]:
            if first > key:
                break
            found += [np.frombuffer(v, f"<u{self.id_width}") for k, v in self._block(at, length, entries) if k == key]
        return found


def write_tables(docs: DataFrame, vocab: str, *, end_id: int = 2, id_width: int = 2, out: str | None = None, shard_bytes: int = 16 << 20, block_bytes: int = 64 << 10) -> DataFrame:
    """Encode every whole text, add end_id, write files below `out`, and return the manifest: a row for each file."""
    out = out or shared_dir(docs.sparkSession)
    n = parts_for(total_bytes(docs), shard_bytes)

    def write(rows):
        from pyarrow import fs

        encode, writer, tmp = encoder(vocab), None, ""
        end = narrow(np.asarray([end_id], np.uint32), id_width).tobytes()
        first = None
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                found, starts, stops = encode.flat(texts[a:b])
                found = narrow(found, id_width)
                for doc_id, x, y in zip(ids[a:b], starts.tolist(), stops.tolist(), strict=True):
                    if writer is None:
                        task, first = TaskContext.get(), key_of(doc_id)
                        store, root = fs.FileSystem.from_uri(out)
                        store.create_dir(root, recursive=True)
                        final = f"{root}/table-{task.partitionId():05d}-{task.taskAttemptId()}.sst"
                        tmp = final + ".part"
                        writer = Writer(store.open_output_stream(tmp), id_width, block_bytes)
                    writer.put(key_of(doc_id), found[x:y].tobytes() + end)
        if writer is not None:
            size = writer.close()
            store.move(tmp, final)
            path = f"{out.rstrip('/')}/{final.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"path": [path], "first_key": [first], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "docs": [writer.docs], "ids": [writer.ids], "bytes": [size]})

    # The text's hash also splits one identifier with very many rows over several files.
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return written(ranged.mapInArrow(write, MANIFEST))


def read_tables(manifest: DataFrame) -> DataFrame:
    """A row for each entry of the files: doc_id, start (ids in all entries before it), n_tokens, ids_crc32."""
    # Tasks are numbered in key order. Sums before a file are taken in two levels: within a run of files, then over runs.
    own = manifest.select("path", "part", "ids", F.floor(F.col("part") / FILES_A_RUN).alias("run"))
    within = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = own.groupBy("run").agg(F.sum("ids").alias("_ids")).select("run", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    placed = own.withColumn("_within", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(runs, "run").select("path", (F.col("_before") + F.col("_within")).alias("start"))

    def read(rows):
        for batch in rows:
            for path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                table, keys, starts, counts, sums = Reader(path), [], [], [], []
                for key, value in table:
                    n = len(value) // table.id_width
                    keys.append(doc_id_of(key))
                    starts.append(start)
                    counts.append(n)
                    sums.append(zlib.crc32(value if table.id_width == 4 else np.frombuffer(value, f"<u{table.id_width}").astype("<u4").tobytes()))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return placed.repartition(files, "path").mapInArrow(read, ROWS)
