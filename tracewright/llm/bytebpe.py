"""Byte-level BPE by a file of ranks: whole texts to ids and ids back to bytes.

Texts are cut where the tokenizer's pattern begins a match; the cuts come from classes of characters, all texts of a
batch at once. Different matches become rows of padded matrices, bucketed by length. In each round every row merges its
leftmost pair of the least rank; ranks of pairs are looked up in a hash table of all splits of all tokens, the row moves
up behind the merge, and rows without a pair leave the matrix. A match that is a token is taken whole, as the library
does. Ids of matches are kept between batches, up to a bound in bytes. Matches of over 1,024 bytes are merged by a heap,
which does the same in n log n steps.

Defined results: a null text counts as empty and has no ids; bytes that are no UTF-8 count as U+FFFD; names of special
tokens are ordinary text; an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import worker_cache

#: No pair.
NONE = np.int32(np.iinfo(np.int32).max)
#: Widths of the matrices; longer matches go through the heap.
WIDTHS = [2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024]
#: Bytes of kept matches and ids in one Python worker, and numbers in one matrix.
MEMO_BYTES, ENTRY_BYTES, CELLS = 120_000_000, 260, 1 << 19
#: Characters cut at once. Longer texts are cut in pieces, each ending before a blank that follows a non-blank.
PIECE = 1 << 19
_END = re.compile(r"[^\s\x1c-\x1f\x85][ \n\t]")
LETTER, NUMBER, SPACE, OTHER, BORDER = range(5)


def classes() -> np.ndarray:
    """The pattern's class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            out[np.frombuffer(m[0].encode("utf-32-le"), "<u4")] = kind
    return out


def tokens_by_rank(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


class Ranks:
    """Tokens by rank, and the table of pairs: at a pair's slot its key and the rank of the two tokens joined."""

    def __init__(self, path: str):
        ranks, tokens = tokens_by_rank(path)
        self.ranks, self.size = ranks, len(tokens)
        self.bytes = np.asarray([ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.fromiter((a * self.size + b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(10, int(4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            # Of keys at a free slot one gets it; the others go on to the next.
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            got = self.keys[slot] == keys
            self.values[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def one(self, left: int, right: int) -> int:
        key = left * self.size + right
        slot = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - self.bits)
        while (held := int(self.keys[slot])) >= 0:
            if held == key:
                return int(self.values[slot])
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return NONE

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's join; NONE where it is no token, or either side is missing (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        there = (left >= 0) & (right >= 0)
        keys = left[there].astype(np.int64) * self.size + right[there]
        slot, found, open_ = self._slot(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            hit = held == keys
            found[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            open_, keys, slot = open_[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        out[there] = found
        return out

    def merged(self, rows: np.ndarray) -> np.ndarray:
        """A matrix of byte ids, padded with -1, with the ids that each row ends as."""
        out = np.full(rows.shape, -1, np.int32)
        own, ranks = np.arange(len(rows)), self.joined(rows[:, :-1], rows[:, 1:])
        while len(own):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(own)), at]
            done = least == NONE
            out[own[done], : rows.shape[1]] = rows[done]
            own, rows, ranks, at, least = (x[~done] for x in (own, rows, ranks, at, least))
            line = np.arange(len(own))
            rows[line, at] = least
            if rows.shape[1] == 2:
                out[own, 0] = rows[:, 0]
                break
            # What stands behind the merge moves up by one.
            rows = np.take_along_axis(rows, np.arange(rows.shape[1] - 1) + (np.arange(rows.shape[1] - 1) > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, np.arange(ranks.shape[1] - 1) + (np.arange(ranks.shape[1] - 1) >= at[:, None]), 1)
            before, after = at > 0, at < rows.shape[1] - 1
            ranks[line[before], at[before] - 1] = self.joined(rows[line[before], at[before] - 1], rows[line[before], at[before]])
            ranks[line[after], at[after]] = self.joined(rows[line[after], at[after]], rows[line[after], at[after] + 1])
        return out

    def long(self, raw: bytes) -> np.ndarray:
        """Ids of one long match: pairs wait in a heap by rank, then place; a pair whose sides have changed is stale."""
        ids = self.bytes[np.frombuffer(raw, np.uint8)]
        n, shift = len(ids), len(ids).bit_length()
        ranks = self.joined(ids[:-1], ids[1:])
        some = np.flatnonzero(ranks != NONE)
        heap = ((ranks[some].astype(np.int64) << shift) | some).tolist()
        heapq.heapify(heap)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting = ranks  # the rank of the pair that begins at each place
        waiting = np.concatenate([waiting, [NONE]])
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> shift, top & ((1 << shift) - 1)
            if waiting[i] != rank:
                continue
            j = int(after[i])
            ids[i], ids[j], waiting[j] = rank, -1, NONE
            k = int(after[j])
            after[i] = k
            if k < n:
                before[k] = i
            for a, b in ((int(before[i]), i), (i, k)):
                if a >= 0 and b < n:
                    waiting[a] = self.one(int(ids[a]), int(ids[b]))
                    if waiting[a] != NONE:
                        heapq.heappush(heap, (int(waiting[a]) << shift) | a)
                elif a == i:
                    waiting[a] = NONE
        return ids[ids >= 0]

    def encoded(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different matches, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        whole = np.fromiter((self.ranks.get(m, -1) for m in matches), np.int64, len(matches))
        bucket = np.where(whole >= 0, -1, np.searchsorted(WIDTHS, sizes))
        order, parts, counts = [np.flatnonzero(bucket == -1)], [whole[whole >= 0].astype(np.int32)], [np.ones(int((whole >= 0).sum()), np.int64)]
        for k in np.flatnonzero(bucket == len(WIDTHS)).tolist():
            order.append(np.asarray([k]))
            parts.append(self.long(matches[k]))
            counts.append(np.asarray([len(parts[-1])]))
        for b, width in enumerate(WIDTHS):
            own = np.flatnonzero(bucket == b)
            for at in range(0, len(own), max(1, CELLS // width)):
                some = own[at : at + max(1, CELLS // width)]
                rows = np.full((len(some), width), -1, np.int32)
                rows[np.arange(width) < sizes[some][:, None]] = self.bytes[np.frombuffer(b"".join([matches[k] for k in some.tolist()]), np.uint8)]
                rows = self.merged(rows)
                order.append(some)
                parts.append(rows[rows >= 0])
                counts.append((rows >= 0).sum(1))
        order, ids, n = np.concatenate(order), np.concatenate(parts), np.concatenate(counts)
        first, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], size[order] = n.cumsum() - n, n
        return gathered(ids, first, size), size


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of a pool, one after the other."""
    ends = size.cumsum()
    return pool[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin. points: code points of texts, with a BORDER before, between and after them."""
    space, border = kind == SPACE, kind == BORDER
    blank = points == 32
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    follows = np.roll(space, 1)
    begin = (kind != before) & ~border
    # A blank goes with what follows it; of other white space the last one before a word stands alone.
    begin &= ~(follows & ~space & np.roll(blank, 1))
    begin |= space & follows & (after != SPACE) & (after != BORDER)
    mark = np.flatnonzero((points == 39) & begin)
    at = lambda k: points[np.minimum(mark + k, len(points) - 1)]
    one = np.isin(at(1), [ord(c) for c in "stmd"])
    two = ((at(1) == ord("r")) | (at(1) == ord("v"))) & (at(2) == ord("e")) | (at(1) == ord("l")) & (at(2) == ord("l"))
    size = np.where(one, 1, np.where(two, 2, 0))
    mark, size = mark[size > 0], size[size > 0]
    begin[mark + 1] = False
    ends = mark + size + 1
    begin[ends[kind[ends] != BORDER]] = True
    # White space right after such an ending begins a match anyway, and so does any other class.
    return begin


class Coder:
    def __init__(self, path: str):
        self.ranks, self.kinds = Ranks(path), classes()
        self._forget()

    def _forget(self) -> None:
        #: Matches by their bytes, as places in first and size, which lead to the pool.
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.size, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.held = 0

    def _learn(self, matches: list[bytes]) -> None:
        ids, sizes = self.ranks.encoded(matches)
        n, m = len(self.known), len(matches)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + len(ids), np.int32)])
        if n + m > len(self.first):
            self.first, self.size = (np.concatenate([x[:n], np.empty(n + m, np.int64)]) for x in (self.first, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + m], self.first[n : n + m] = sizes, self.used + sizes.cumsum() - sizes
        self.known.update(zip(matches, range(n, n + m), strict=True))
        self.used += len(ids)
        self.held += 4 * len(ids) + ENTRY_BYTES * m + sum(map(len, matches))

    def matches(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All matches of the texts in order, and how many each text has."""
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        border = np.concatenate([[0], (sizes + 1).cumsum()])
        kind[border] = BORDER
        begin = starts(points, kind)
        width = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        width[border] = 0
        place = width.cumsum() - width
        data = "".join(texts).encode("utf-8", "surrogatepass")
        edges = np.concatenate([place[begin], [len(data)]])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        return found, np.add.reduceat(begin.astype(np.int64), border[:-1]) if len(texts) else np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if self.held > MEMO_BYTES:
            self._forget()
        found, counts = self.matches(texts)
        coded = found.dictionary_encode()
        edges, data = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist(), (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        different = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if new := [m for m in different if m not in self.known]:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        n = self.size[place]
        ends = np.concatenate([[0], n.cumsum()])
        return gathered(self.pool, self.first[place], n), np.diff(ends[np.concatenate([[0], counts.cumsum()])])


def coder(path: str) -> Coder:
    own = worker_cache("bytebpe")
    if path not in own:
        own[path] = Coder(path)
    return own[path]


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = _END.search(text, at + PIECE)
        if end is None:
            break
        yield text[at : end.start() + 1]
        at = end.start() + 1
    yield text[at:]


def groups(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of about PIECE characters together, with the place of each one's text."""
    own, some, size = [], [], 0
    for k, text in enumerate(texts):
        for p in pieces(text):
            own.append(k)
            some.append(p)
            size += len(p)
            if size >= PIECE:
                yield own, some
                own, some, size = [], [], 0
    if own:
        yield own, some


def encoded(docs: DataFrame, path: str, *, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (array of int) of each whole text, by the ranks in the file at `path` on every machine."""

    def encode(batches):
        own = coder(path)
        for batch in batches:
            sizes_ = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().cumsum()
            start = 0
            while start < batch.num_rows:
                before = sizes_[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes_, before + 4 * PIECE, "right")))
                texts = [(r or b"").decode("utf-8", "replace") for r in batch.column(1).slice(start, end - start).to_pylist()]
                sizes, parts = np.zeros(len(texts), np.int64), []
                for at, some in groups(texts):
                    ids, n = own.ids(some)
                    np.add.at(sizes, at, n)
                    parts.append(ids)
                values = np.concatenate(parts) if parts else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], [key, "ids"])
                start = end

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(column).cast("binary")).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def decoded(docs: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """key, ids and the bytes that they stand for. An id that is no rank is an error."""

    def decode(batches):
        own = worker_cache("bytebpe")
        if ("tokens", path) not in own:
            own["tokens", path] = pa.array(tokens_by_rank(path)[1], pa.large_binary())
        tokens = own["tokens", path]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                lists = some.column(1)
                edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = pc.take(tokens, lists.flatten())
                places = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
                bounds = places[edges].astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds), flat.buffers()[2] if len(flat) else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([some.column(0), lists, raw], [key, "ids", "raw"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "ids").mapInArrow(decode, f"{key} {kind}, ids array<int>, raw binary")
