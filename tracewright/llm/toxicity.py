"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found in an inverted index.

At most `max_rows` labelled rows, those with the least hash of doc_id, train and are the examples; of near copies with
one label one counts. Terms are words in lower case and their beginnings of five letters. The vocabulary is all
terms that an example has, known by 64-bit hashes (of a million terms two agree with probability 3e-8), and all examples are in the index. Document frequencies are counted over all documents. A
term that toxic examples have more often weighs one plus its log-likelihood ratio times as much as another; none is left
out. The k nearest are exact (ties: the smaller doc_id). Votes weighted
by closeness give a raw score, which an isotonic fit on the examples (each scored without itself) makes a probability.
Each row carries its nearest examples as evidence.

Training rows are those whose crc32(doc_id) mod `folds` is not 0, the others are held out. Labels, lang, source and
doc_id enter no score.

Defined results: null, empty and all other texts without a vocabulary term get the toxic share of the examples without
words; with no labels every score is 0; rows that repeat each give a row; an empty table gives none. Extra columns are
not read; a repeated label counts as its largest.
"""

from __future__ import annotations

import os
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import give_back, mixed, rolling, shared_dir, word_hashes, words, worker_cache, written

EDGE = ".,;:!?\"'()[]{}*#|<>-_/\\&%$"
#: Bytes of words kept by a worker, with about so many for what is known of each; terms counted before they are sent on.
MEMO_BYTES, ENTRY_BYTES, MEMO = 40_000_000, 200, 400_000
TIE = 1e-6
#: Sums in single precision differ from exact ones by less than this; queries looked up together.
NEAR, TOGETHER = 1e-5, 64
#: Postings added up at once.
PIECE = 65_536
#: Bits of a posting that hold its place; the weight above them keeps 24 bits and more, as in single precision.
PLACES = (1 << 28) - 1
#: One MinHash value each; near copies agree on all.
SALTS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
EVIDENCE = "array<struct<doc_id:bigint,toxic:int,similarity:double>>"


def terms_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower().strip(EDGE)
    return [w, f"{w[:5]}*"] if len(w) > 5 else [w] if w else []


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def hashed(terms: list[str]) -> np.ndarray:
    return word_hashes([t.encode("utf-8", "surrogatepass") for t in terms])


class Terms:
    """From words to vocabulary numbers, with a bounded memory. Texts are split and their words told apart in Arrow.

    The vocabulary is the sorted 64-bit hashes of its terms (or the terms): eight bytes for each, however long it is."""

    def __init__(self, vocabulary: np.ndarray | list[str]):
        self.hashes = vocabulary if isinstance(vocabulary, np.ndarray) else np.sort(hashed(vocabulary))
        self.memo, self.held = {}, 0

    def _found(self, words_: pa.Array) -> np.ndarray:
        """The numbers of each word's terms, -1 where there is none."""
        plain = pc.string_is_ascii(words_)
        own = plain.to_numpy(zero_copy_only=False)
        out = np.full((len(words_), 2), -1)
        out[own] = self._plain(words_.filter(plain))
        if not own.all():
            out[~own] = self._any(words_.filter(pc.invert(plain)).to_pylist())
        return out

    def _plain(self, words_: pa.Array) -> np.ndarray:
        """_found for ASCII words, told apart and cut as columns: most words of a corpus are met once."""
        low = pc.ascii_trim(pc.ascii_lower(words_), characters=EDGE).dictionary_encode()
        whole = low.dictionary
        long = pc.greater(pc.binary_length(whole), 5)
        begins = pc.binary_join_element_wise(pc.utf8_slice_codeunits(whole.filter(long), 0, 5), pa.scalar("*", whole.type), pa.scalar("", whole.type)).dictionary_encode()
        known = lambda terms: self._numbers(word_hashes(terms.cast(pa.large_binary()).to_pylist()))
        numbers = np.full((len(whole), 2), -1)
        numbers[:, 0] = np.where(pc.equal(whole, "").to_numpy(zero_copy_only=False), -1, known(whole))
        numbers[long.to_numpy(zero_copy_only=False), 1] = known(begins.dictionary)[begins.indices.to_numpy()]
        return numbers[low.indices.to_numpy()]

    def _any(self, words_: list[str]) -> np.ndarray:
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        new = [w for w in words_ if w not in memo]
        own = [terms_of(w.encode()) for w in new]
        found = iter(self._numbers(hashed([t for terms in own for t in terms])).tolist())
        for w, terms in zip(new, own, strict=True):
            memo[w] = (next(found) if terms else -1, next(found) if len(terms) > 1 else -1)
            self.held += 2 * len(w) + ENTRY_BYTES
        return np.fromiter(chain.from_iterable(map(memo.__getitem__, words_)), np.int64, 2 * len(words_)).reshape(-1, 2)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, term, how often) for all terms of each text, in order of both."""
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        terms = self._found(coded.dictionary)[coded.indices.to_numpy()]
        edges = lists.offsets.to_numpy()
        doc = np.repeat(np.arange(len(texts)), np.diff(edges))
        key = (doc[:, None] * (len(self.hashes) + 1) + terms)[terms >= 0]
        key, n = np.unique(key, return_counts=True)
        return key // (len(self.hashes) + 1), key % (len(self.hashes) + 1), n

    def numbers(self, text: str | None) -> list[int]:
        return self.counted([text])[1].tolist()

    def vectors(self, texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the vocabulary numbers and weights of length one; both empty where no term occurs."""
        out = []
        for start in range(0, len(texts), 256):
            some = texts[start : start + 256]
            doc, t, n = self.counted(some)
            out += weighed(t, n, np.bincount(doc, minlength=len(some)), idf)
        return out

    def vector(self, text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text], idf)[0]


def weighed(t: np.ndarray, n: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of length one of texts that have so many (sizes) of the terms t, each n times."""
    w, ends = (1 + np.log(n)) * idf[t], sizes.cumsum()
    w /= np.repeat(np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w * w, len(sizes))), sizes)
    return [(t[a:b], w[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def made(folder: str | None, name: str, shape, kind) -> np.ndarray:
    """A new array in memory, or in a file of the folder, which mapped() reads."""
    if folder is None:
        return np.empty(shape, kind)
    return np.asarray(np.lib.format.open_memmap(f"{folder}/{name}.npy", "w+", kind, shape if isinstance(shape, tuple) else (shape,)))


def mapped(folder: str, name: str) -> np.ndarray:
    return np.asarray(np.load(f"{folder}/{name}.npy", mmap_mode="r"))


class BlockMax:
    """Examples by term; exact k nearest by cosine.

    Terms that few examples have are added up by their postings. The `common` others, which make most postings of a query,
    are rows of one dense table, so that a batch of queries meets all examples in one product. The greatest cosines of
    blocks of examples bound the k-th one from below; what comes out near the front is added up again in full precision.
    """

    #: Arrays that a folder holds.
    HELD = ("ids", "toxic", "dense", "ends", "terms", "weights", "first", "postings", "tables")

    def __init__(self, vectors, ids, toxic, size: int, block: int = 64, first_blocks: int = 4, common: int = 512, folder: str | None = None):
        """folder: where the arrays are made, with all that lookups need, for opened()."""
        n = np.zeros(size, np.int64)
        for t, _ in vectors:
            n[t] += 1
        often = np.sort(np.argsort(-n, kind="stable")[:common])
        self.block, self.first_blocks, self.size = block, first_blocks, size
        self.dense = made(folder, "dense", size, np.int32)  # a term's row in the dense tables
        self.dense[:] = -1
        self.dense[often[n[often] > 0]] = np.arange((n[often] > 0).sum())
        heavy = np.asarray([t[w.argmax()] if len(t) else -1 for t, w in vectors], np.int64)
        lead = np.asarray([t[np.where(self.dense[t] >= 0, w, -1).argmax()] if len(t) else -1 for t, w in vectors], np.int64)
        own = np.lexsort((np.asarray(ids, np.int64), heavy, lead))
        self.ids, self.toxic, self.ends = (made(folder, c, len(own) + (c == "ends"), np.int64) for c in ("ids", "toxic", "ends"))
        self.ids[:], self.toxic[:], self.ends[0] = np.asarray(ids, np.int64)[own], np.asarray(toxic, np.int64)[own], 0
        self.ends[1:] = np.cumsum([len(vectors[k][0]) for k in own])
        self.terms, self.weights = (made(folder, c, int(self.ends[-1]), kind) for c, kind in (("terms", np.int32), ("weights", np.result_type(np.float32, *{w.dtype for _, w in vectors}))))
        for k, a, b in zip(own.tolist(), self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            self.terms[a:b], self.weights[a:b] = vectors[k]
        self._held()
        if folder is not None:
            self._index(folder)

    @classmethod
    def opened(cls, folder: str, block: int, first_blocks: int, size: int) -> BlockMax:
        """An index whose arrays are mapped files: processes of one machine share them, and none holds a copy."""
        self = cls.__new__(cls)
        self.block, self.first_blocks, self.size = block, first_blocks, size
        for name in cls.HELD:
            setattr(self, name, mapped(folder, name))
        tables = self.tables
        self._held()
        self._buffers()
        self.tables = tables
        return self

    def _held(self) -> None:
        self.tables = self.front = None
        self.place_of, self.edges = dict(zip(self.ids.tolist(), range(len(self.ids)), strict=True)), self.ends.tolist()

    def vector(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.edges[place], self.edges[place + 1])
        return self.terms[own], self.weights[own]

    def _index(self, folder: str | None = None) -> None:
        """Postings of the rare terms, and the dense table; made where queries are looked up if there is no folder."""
        n = np.zeros(self.size, np.int64)
        edges = [*range(0, len(self.ids), 512), len(self.ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            t = self.terms[self.ends[a] : self.ends[b]]
            n += np.bincount(t[self.dense[t] < 0], minlength=self.size)
        self.first = made(folder, "first", self.size + 1, np.int32)
        self.first[0], self.first[1:] = 0, n.cumsum()
        # A posting is one number: the weight in double precision, and in its last bits the place.
        self.postings, free = made(folder, "postings", int(n.sum()), np.int64), self.first[:-1].copy()
        # The weights of the common terms (terms, examples); blocks of examples are filled up with zeros.
        tables = made(folder, "tables", (int(self.dense.max(initial=-1)) + 1, -(-len(self.ids) // self.block) * self.block), np.float32)
        tables[:] = 0
        for a, b in zip(edges, edges[1:], strict=False):
            own = slice(self.ends[a], self.ends[b])
            terms, weight = self.terms[own], self.weights[own]
            place, row = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(self.ends[a : b + 1])), self.dense[terms]
            tables[row[row >= 0], place[row >= 0]] = weight[row >= 0]
            place, weight, terms = place[row < 0], weight[row < 0], terms[row < 0]
            order = np.argsort(terms, kind="stable")
            own, at, held = np.unique(terms[order], return_index=True, return_counts=True)
            to = np.repeat(free[own] - at, held) + np.arange(len(order))
            self.postings[to] = (weight[order].astype(np.float64).view(np.int64) & ~PLACES) | place[order]
            free[own] += held.astype(np.int32)
        self._buffers()
        self.tables = tables

    def _buffers(self) -> None:
        """A lookup writes into these: fresh arrays of this size would be mapped and given back each time."""
        most = PIECE + int(np.diff(self.first).max(initial=0))
        self.query, self.sums, self.piece, self.part = np.zeros(self.size), np.empty(len(self.ids)), np.empty(most, np.int64), np.empty(most)

    def __getstate__(self):
        """Only the examples are sent: all else is made again from them."""
        return {c: getattr(self, c) for c in ("ids", "toxic", "dense", "ends", "terms", "weights", "block", "first_blocks", "size")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._held()

    def _tables(self) -> np.ndarray:
        if self.tables is None:
            self._index()
            give_back()
        return self.tables

    def _add_up(self, first: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each example the sum of its weights in lists of so many (n) postings, times w. Postings are read a piece at
        a time, so that a piece stays in the processor's cache and a long text takes no more memory than a short one."""
        self.sums[:] = 0
        before = n.cumsum()
        edges = [0, len(n)]
        if len(n) and before[-1] > PIECE:
            edges = np.unique([*np.searchsorted(before - n, np.arange(0, before[-1], PIECE)), len(n)]).tolist()
        begins, ends = first.tolist(), (first + n).tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            if x == y:
                continue
            total = int(before[y - 1] - before[x] + n[x])
            both, part = self.piece[:total], self.part[:total]
            np.concatenate([self.postings[a:b] for a, b in zip(begins[x:y], ends[x:y], strict=True)], out=both)
            np.multiply(both.view(np.float64), np.repeat(w[x:y], n[x:y]), out=part)
            np.bitwise_and(both, PLACES, out=both)
            np.add.at(self.sums, both, part)
        return self.sums

    def nearest_of(self, queries, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms in order, weights) the places and cosines, from the nearest; only examples that share a
        term. without: a place for each query that doesn't count."""
        size = len(self.ids)
        if not size:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        tables = self._tables()
        dense = np.zeros((len(queries), len(tables)), np.float32)
        terms, weights = (np.concatenate([x[c] for x in queries]) for c in (0, 1))
        query, row = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries]), self.dense[terms]
        dense[query[row >= 0], row[row >= 0]] = weights[row >= 0]
        if self.front is None or len(self.front) < len(queries):
            self.front = np.empty((len(queries), tables.shape[1]), np.float32)
        found = np.matmul(dense, tables, out=self.front[: len(queries)])
        first = self.first[terms].astype(np.int64)
        n = self.first[terms + 1] - first
        first, w, edges = first[n > 0], weights[n > 0], np.bincount(query[n > 0], minlength=len(queries)).cumsum().tolist()
        n = n[n > 0]
        for q, (a, b) in enumerate(zip([0, *edges], edges, strict=False)):
            found[q, :size] += self._add_up(first[a:b], n[a:b], w[a:b])
        if without is not None:
            found[np.arange(len(queries)), without] = -9
        found[:, size:] = -9
        best = found.reshape(len(queries), -1, self.block).max(2)
        # As many blocks hold one that is as near as the k-th best block's; of fewer blocks all examples are asked.
        least = np.partition(best, best.shape[1] - k, 1)[:, best.shape[1] - k] if best.shape[1] >= k else np.zeros(len(queries), np.float32)

        def front_of(q: int) -> np.ndarray:
            """Places that may be among the k nearest; least is at most the k-th cosine."""
            at = np.flatnonzero(found[q] >= least[q] - NEAR) if least[q] > NEAR else np.flatnonzero(found[q] > 0)
            return at[found[q, at] >= np.partition(found[q, at], len(at) - k)[len(at) - k] - NEAR] if len(at) > k else at

        return [self._exact(t, w, front_of(q), k) for q, (t, w) in enumerate(queries)]

    def _exact(self, t: np.ndarray, w: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(places):
            return places, np.zeros(0)
        own = [slice(self.edges[p], self.edges[p + 1]) for p in places.tolist()]
        n = np.asarray([x.stop - x.start for x in own])
        self.query[t] = w
        cosines = np.add.reduceat(self.query.take(np.concatenate([self.terms[x] for x in own])) * np.concatenate([self.weights[x] for x in own]), n.cumsum() - n)
        self.query[t] = 0
        order = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
        order = order[cosines[order] > 0]
        return places[order], cosines[order]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(t, w)], k, None if without is None else [without])[0]


def isotonic(raw: list[tuple[float, int]], share: float) -> tuple[np.ndarray, np.ndarray]:
    """From raw scores to probabilities: equal neighbours in violation are pooled."""
    pools: list[list[float]] = []
    for score, y in sorted(raw):
        pools.append([score, score, y, 1])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.asarray([x for p in pools for x in p[:2]]), np.repeat([(p[2] + share) / (p[3] + 1) for p in pools], 2)


class Model:
    def __init__(self, vocabulary, idf, index: BlockMax, without: float, share: float, k: int):
        self.vocabulary, self.idf, self.index, self.without, self.share, self.k = vocabulary, idf, index, without, share, k

    def raw(self, at: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cosine, 1))
        return float((w @ self.index.toxic[at] + self.share) / (w.sum() + 1))

    def scores(self, vectors, x: np.ndarray, y: np.ndarray) -> list[tuple[float, list[dict]]]:
        out: list[tuple[float, list[dict]]] = [(self.without, [])] * len(vectors)
        some = [k for k, (t, _) in enumerate(vectors) if len(t)] if len(self.index.ids) else []
        for start in range(0, len(some), TOGETHER):
            own = some[start : start + TOGETHER]
            for k, (at, cosine) in zip(own, self.index.nearest_of([vectors[k] for k in own], self.k), strict=True):
                if not len(at):
                    out[k] = (self.share, [])
                    continue
                raw = self.raw(at, cosine)
                # The calibrated score; the raw one only orders what the fit makes equal.
                score = (1 - TIE) * float(np.interp(raw, x, y)) + TIE * raw
                out[k] = (score, [{"doc_id": int(self.index.ids[p]), "toxic": int(self.index.toxic[p]), "similarity": float(c)} for p, c in zip(at[:3], cosine[:3], strict=True)])
        return out


class Filed:
    """A model whose arrays are files of the shared folder. A worker maps them, so that the workers of an executor have
    them once between them, in memory that the system can take back."""

    def __init__(self, folder: str, index: tuple, rest: tuple):
        self.folder, self.index, self.rest = folder, index, rest

    @property
    def value(self) -> Model:
        held = worker_cache("toxicity")
        if self.folder not in held:
            held.clear()
            held[self.folder] = Model(mapped(self.folder, "vocabulary"), mapped(self.folder, "idf"), BlockMax.opened(self.folder, *self.index), *self.rest)
        return held[self.folder]


def sent(spark: SparkSession, vocabulary: np.ndarray, idf: np.ndarray, vectors, ids, toxic, *rest):
    """The model for the workers: files, or a broadcast where the shared folder is none of the file system."""
    where = urlparse(shared_dir(spark))
    if where.scheme != "file":
        return spark.sparkContext.broadcast(Model(vocabulary, idf, BlockMax(vectors, ids, toxic, len(vocabulary)), *rest))
    os.makedirs(folder := unquote(where.path))
    for name, x in (("vocabulary", vocabulary), ("idf", idf)):
        made(folder, name, len(x), x.dtype)[:] = x
    index = BlockMax(vectors, ids, toxic, len(vocabulary), folder=folder)
    return Filed(folder, (index.block, index.first_blocks, index.size), rest)


def parts_of(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The arrays that a column of bytes holds, without copies of them."""
    out = []
    for chunk in column.chunks:
        data, edges = np.frombuffer(chunk.buffers()[2] or b"", np.uint8), np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        out += [data[a:b].view(kind) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def fitted(docs: DataFrame, labels: DataFrame, *, folds: int, max_rows: int, k: int, keep: bool = False):
    """The model for the workers, its isotonic curve and, if kept, the terms of each row of docs as a table (doc_id, t, n), so
    that texts are split once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold("doc_id", folds) != 0)
    known = known.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(max_rows)

    def keyed(batches):
        worker_cache("toxicity")
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                h = word_hashes(words(text))
                runs = rolling(h, min(3, len(h))) if len(h) else h
                keys.append(b"".join([mixed(runs ^ np.uint64(salt)).min().tobytes() for salt in SALTS]) if len(h) else b"")
            yield batch.append_column("key", pa.array(keys, pa.binary()))

    # The sample is bounded, so it may be broadcast; of near copies with one label (all MinHash values agree) one trains.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(keyed, "doc_id long, text string, toxic int, key binary")
    training = sample.groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("own")).select("own.*")
    training = written(training.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))

    def distinct_terms(batches):
        worker_cache("toxicity")
        known: dict[bytes, list[int]] = {}
        found: dict[int, list[int]] = {}

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(np.fromiter(found, np.uint64, len(found)).view(np.int64)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["term", "clean", "toxic"])
            found.clear()
            known.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                terms: set[int] = set()
                for w in set(words(text)):
                    if w not in known:
                        known[w] = hashed(terms_of(w)).tolist()
                    terms.update(known[w])
                for term in terms:
                    if term in found:
                        found[term][toxic] += 1
                    else:
                        found[term] = [1 - toxic, toxic]
                if len(found) > MEMO // 2:
                    yield flushed()
        yield flushed()

    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = training.select("text", "toxic").mapInArrow(distinct_terms, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1")).toArrow()
    vocabulary = counts.column("term").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, c0, c1 = vocabulary[order], *(counts.column(c).to_numpy()[order].astype(float) for c in ("c0", "c1"))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(c > 0, c * np.log(c * (n0 + n1) / ((c0 + c1) * n)), 0.0) for c, n in ((c0, n0), (c1, n1)))
    lean = 1 + np.where(c1 * n0 > c0 * n1, ratio, 0.0)
    del counts, c0, c1

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def terms(batches, columns=("doc_id", "t", "n")):
        worker_cache("toxicity")
        read = Terms(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for start in range(0, len(texts), 1000):
                some = texts.slice(start, 1000).to_pylist()
                doc, t, n = read.counted(some)
                t, n, edges = t.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), 4 * np.searchsorted(doc, np.arange(len(some) + 1))
                cut = lambda data, e=edges.tolist(): pa.array([data[x:y] for x, y in zip(e, e[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(some)), cut(t), cut(n)], ["doc_id", "t", "n"]).select(list(columns))

    def frequencies(batches):
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    # One function over the texts: of two, one after the other, each would have a worker for each core, and idle ones stay.
    frequencies_of_texts = lambda batches: frequencies(terms(batches, ["t"]))
    frequent = docs.select("doc_id", "text").mapInArrow(frequencies_of_texts, "term long, n long")
    counted = None
    if keep and len(vocabulary):
        counted = written(docs.select("doc_id", "text").mapInArrow(terms, "doc_id long, t binary, n binary"), compression="zstd")
        frequent = counted.select("t").mapInArrow(frequencies, "term long, n long")
    found = df = None
    idf = np.zeros(len(vocabulary))
    if len(vocabulary):
        total = docs.count()
        df = np.zeros(len(vocabulary))
        found = frequent.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[found.column("term").to_numpy()] = found.column("n").to_numpy()
        idf = (np.log((1 + total) / (1 + df)) + 1) * lean

    def vectors(batches):
        worker_cache("toxicity")
        read = Terms(shared.value)
        for batch in batches:
            own = read.vectors(batch.column("text").to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([t.astype(np.int32).tobytes() for t, _ in own], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in own], pa.binary())], ["doc_id", "toxic", "t", "w"])

    rows = training.mapInArrow(vectors, "doc_id long, toxic int, t binary, w binary").toArrow().sort_by("doc_id")
    shared.destroy()
    toxic = rows.column("toxic").to_numpy()
    some = np.asarray([len(t) > 0 for t in rows.column("t").to_pylist()], bool)
    share, without = float(toxic.sum()) / max(1, len(toxic)), float(toxic[~some].mean()) if (~some).any() else 0.0
    rows = rows.filter(pa.array(some, pa.bool_()))
    own = list(zip(parts_of(rows.column("t"), np.int32), parts_of(rows.column("w"), np.float32), strict=True))
    model = sent(spark, vocabulary, idf, own, rows.column("doc_id").to_numpy(), toxic[some], without, share, k)
    del rows, own, found, df
    give_back()

    def without_itself(batches):
        worker_cache("toxicity")
        m = model.value
        for batch in batches:
            # An example's own vector is in the index, so its text isn't split again.
            places = [m.index.place_of.get(d) for d in batch.column("doc_id").to_pylist()]
            raw = [None] * len(places)
            some = [i for i, p in enumerate(places) if p is not None]
            for start in range(0, len(some), TOGETHER):
                own = some[start : start + TOGETHER]
                for i, (at, cosine) in zip(own, m.index.nearest_of([m.index.vector(places[i]) for i in own], k, [places[i] for i in own]), strict=True):
                    raw[i] = m.raw(at, cosine)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(raw, pa.float64())], ["toxic", "raw"])

    raw = training.select("doc_id", "toxic").mapInArrow(without_itself, "toxic int, raw double").where("raw is not null").toArrow()
    return model, isotonic(list(zip(raw.column("raw").to_pylist(), raw.column("toxic").to_pylist(), strict=True)), share), counted


def scored(docs: DataFrame, labels: DataFrame, *, folds: int = 5, max_rows: int = 20_000, k: int = 15) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence, a row for each row of docs."""
    model, curve, counted = fitted(docs, labels, folds=folds, max_rows=max_rows, k=k, keep=True)
    if counted is None:  # no label, so no terms
        counted = docs.select("doc_id", F.lit(b"").alias("t"), F.lit(b"").alias("n"))

    def score(batches):
        worker_cache("toxicity")
        own = model.value
        for batch in batches:
            t, n = (batch.column(c).to_pylist() for c in (1, 2))
            sizes = np.asarray([len(x) // 4 for x in t], np.int64)
            found = []
            for at in range(0, len(t), 4 * TOGETHER):
                some = slice(at, at + 4 * TOGETHER)
                found += own.scores(weighed(np.frombuffer(b"".join(t[some]), np.int32).astype(np.int64), np.frombuffer(b"".join(n[some]), np.int32), sizes[some], own.idf), *curve)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], kind)], ["doc_id", "score", "evidence"])

    out = counted.mapInArrow(score, f"doc_id long, score double, evidence {EVIDENCE}")
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def clean(docs: DataFrame, labels: DataFrame, *, cut: float = 0.5, folds: int = 5, max_rows: int = 20_000, k: int = 15) -> DataFrame:
    """The rows of docs with a score below `cut`, all columns kept; nothing is shuffled to drop the others."""
    model, curve, _ = fitted(docs, labels, folds=folds, max_rows=max_rows, k=k)

    def keep(batches):
        worker_cache("toxicity")
        own = model.value
        read = Terms(own.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * TOGETHER):
                some = batch.slice(at, 4 * TOGETHER)
                scores = own.scores(read.vectors(some.column("text").to_pylist(), own.idf), *curve)
                yield some.filter(pa.array([x < cut for x, _ in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
