"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping segments; a document is contaminated where a segment occurs in it within its
edit budget (a share of its length). A segment of n characters with at most e edits keeps at least n - q + 1 - q * e of
its q-grams, all on diagonals (place in the document less place in the segment) that differ by at most e. So: look up
every q-gram of every document, keep stretches dense enough for any segment, count hits by segment in overlapping bands
of 2e + 1 diagonals, retain bands that reach the bound, and verify them by banded alignment.

Characters are bytes of the UTF-8 text with A-Z in lower case and white space (U+0009 to U+000D) as a space.

The segments travel with the code. Their size is checked: a benchmark of more than `block_bytes` is taken in blocks,
each against all documents, one after the other, so that workers hold one index at a time. Texts longer than CHUNK are
looked through in overlapping parts.

Text that repeats itself (rules of dashes, blanks, one word again and again) costs what its bands cost: places of a gram
at equal distances are counted at once, and of long stretches with a short period only the ends are looked through, as
each place in between equals one of those.

A quote of segment * 3 / 2 characters of a longer item holds a whole segment, wherever it begins: from that length on
(144 as set) a match is sure, within the budget.

Items of fewer than `least` characters leave no room for edits: they match where a text holds them whole, with no
letter or digit right before or after (an automaton finds them all in one pass).

Defined results: null and empty texts and items match nothing, nor do items of white space; rows that repeat each give their matches; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import ahocorasick

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import total_bytes, worker_cache, written

MATCHES = "doc_id long, item_id long, start int, length int, edits int"
Q = 8
FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
TABLE_BITS = 22
CHUNK = 4_000_000
#: Rows of postings counted at a time, bands aligned at a time; more bands than a part of a text has.
PIECE, TOGETHER, BANDS = 1_000_000, 20_000, 1 << 24
WORDY = re.compile(rb"[0-9a-z\x80-\xff]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def grams(data: bytes) -> np.ndarray:
    """The 8-gram at each place, as a number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", buffer=data, strides=(1,)) if len(data) >= Q else np.empty(0, "<u8")


def aligned(segments: np.ndarray, regions: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edits between its segment and any part of its region, and where the first such part ends;
    budget + 1 where there are more. A region is 4 * budget longer than its segment: so many diagonals are the band."""
    n, width = segments.shape[1], regions.shape[1] - segments.shape[1] + 1
    edits, ends = np.full(len(segments), budget + 1), np.zeros(len(segments), np.int64)
    alive, row, steps = np.arange(len(segments)), np.zeros((len(segments), width), np.int16), np.arange(width, dtype=np.int16)
    for i in range(n):
        new = row + (regions[:, i : i + width] != segments[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions, all at once
        if i % 8 == 7:
            some = row.min(1) <= budget
            if not some.all():
                alive, row, regions, segments = alive[some], row[some], regions[some], segments[some]
            if not len(alive):
                break
    edits[alive] = np.minimum(row.min(1, initial=budget + 1), budget + 1)
    ends[alive] = n + row.argmin(1) if len(alive) else 0
    return edits, ends


def banded_distance(segment: bytes, region: bytes, budget: int) -> tuple[int, int]:
    """The least edits between the segment and any part of the region, and where that part ends."""
    pad = b"\xff" * len(segment)
    edits, ends = aligned(np.frombuffer(segment, np.uint8)[None], np.frombuffer(pad + region + pad, np.uint8)[None], budget)
    return (int(edits[0]), max(0, int(ends[0]) - len(segment))) if edits[0] <= budget else (budget + 1, 0)


class Index:
    def __init__(self, items: list[tuple[int, str]], ratio: float, segment: int, least: int):
        self.segments: list[tuple[int, bytes, int, int]] = []
        short: dict[str, list[int]] = {}
        for item_id, text in items:
            data = folded(text).strip()
            if len(data) < least:
                if data:
                    short.setdefault(data.decode("latin-1"), []).append(item_id)
                continue
            n = max(1, math.ceil((len(data) - segment) / (segment // 2)) + 1) if len(data) > segment else 1
            for k in range(n):
                at = min(k * (segment // 2), max(0, len(data) - segment))
                own = data[at : at + segment]
                e = int(min(ratio * len(own), (len(own) - Q) // Q - 1))
                self.segments.append((item_id, own, e, len(own) - Q + 1 - Q * e))
        self.edits = np.asarray([e for _, _, e, _ in self.segments], np.int64)
        g = [grams(s) for _, s, _, _ in self.segments]
        flat, of = np.concatenate([*g, np.empty(0, "<u8")]), np.repeat(np.arange(len(g)), [len(x) for x in g])
        at = np.concatenate([*[np.arange(len(x)) for x in g], np.empty(0, np.int64)]).astype(np.int64)
        order = np.lexsort((at, of, flat))
        flat, of, at = flat[order], of[order], at[order]
        # Places of a gram in a segment that lie no further apart than a band is wide are one stretch.
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1]) | (np.diff(at) > self.edits[of[1:]] + 1)
        first = np.flatnonzero(new)
        self.grams, self.of, self.at = flat[first], of[first], at[first]
        self.upto = at[np.append(first[1:], len(flat)) - 1] if len(first) else at[first]
        self.cost = np.append(0, ((self.upto - self.at) // (self.edits[self.of] + 1) + 2).cumsum())
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.grams)] = True
        self.need = np.asarray([t for _, _, _, t in self.segments], np.int64)
        self.reach = max((len(s) + e for _, s, e, _ in self.segments), default=0)
        self.short = ahocorasick.Automaton() if short else None
        for data, ids in short.items():
            self.short.add_word(data, (len(data), ids))
        if self.short:
            self.short.make_automaton()

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (g * MIX) >> np.uint64(64 - TABLE_BITS)

    def whole(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item, start, end) of the first place of each short item that stands there whole."""
        found: dict[int, tuple[int, int, int]] = {}
        for last, (n, ids) in self.short.iter(data.decode("latin-1")) if self.short else ():
            if ids[0] in found and all(item in found for item in ids):
                continue
            start, end = last + 1 - n, last + 1
            before, after = data[start - 1 : start] if start else b"", data[end : end + 1]
            if not (WORDY.match(before) and WORDY.match(data[start : start + 1])) and not (WORDY.match(after) and WORDY.match(data[last:end])):
                for item in ids:
                    found.setdefault(item, (item, start, end))
        return list(found.values())

    def matches(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of all verified places."""
        if len(data) <= CHUNK:
            return self._matches(data)
        overlap, out = 4 * self.reach + 64, []
        for at in range(0, len(data), CHUNK):
            out += [(s, start + at, end + at, edits) for s, start, end, edits in self._matches(data[at : at + CHUNK + overlap])]
        return out

    def _matches(self, data: bytes) -> list[tuple[int, int, int, int]]:
        if not self.segments or len(data) < Q:
            return []
        hit = np.flatnonzero(self.table[self.slot(grams(data))])
        if not len(hit):
            return []
        # Of a match, all hits lie within `reach`: drop hits with too few others in every such stretch.
        need = int(self.need.min())
        ahead = np.searchsorted(hit, hit + self.reach) - np.arange(len(hit))
        dense = np.flatnonzero(ahead >= need)
        cover = np.zeros(len(hit) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, dense + ahead[dense], -1)
        hit = hit[cover[:-1].cumsum() > 0]
        if not len(hit):
            return []
        order = np.argsort(grams(data)[hit], kind="stable")
        own, place = grams(data)[hit][order], hit[order]
        gap = np.full(len(place), -1, np.int64)  # to the last place of the same gram
        gap[1:] = np.where((own[1:] == own[:-1]) & (np.diff(place) <= self.reach), np.diff(place), -1)
        cuts = self._repeats(hit, order, gap)
        if cuts:
            return self._without(data, cuts)
        segment, band = self._bands(own, place, gap)
        out, last = [], {}
        edits, ends = self._verified(data, segment, band)
        some = np.flatnonzero(edits <= self.edits[segment])
        for s, end, e in zip(segment[some].tolist(), ends[some].tolist(), edits[some].tolist(), strict=True):
            if last.get(s, -1) < end:
                last[s] = end
                out.append((s, max(0, end - len(self.segments[s][1])), end, e))
        return out

    def _repeats(self, hit: np.ndarray, order: np.ndarray, gap: np.ndarray) -> list[tuple[int, int]]:
        """(place, length) of what may be cut out of stretches that repeat a short period.

        Whole periods go from the middle and both ends stay for longer than a match can be, so that any stretch of
        that length stands in what is left as well, at its first place in the text."""
        period = np.empty(len(hit), np.int64)
        period[order] = gap
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(period) != 0)]))
        size, at, p = np.diff(np.append(edge, len(hit))), hit[edge], period[edge]
        keep = 2 * self.reach + p
        spare = np.where(p > 0, (size - 2 * keep) // np.maximum(p, 1) * p, 0)
        return [(int(at[k] + keep[k]), int(spare[k])) for k in np.flatnonzero(spare > 2 * self.reach)]

    def _without(self, data: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        parts, at = [], 0
        for place, n in cuts:
            parts.append(data[at:place])
            at = place + n
        seams, gone = np.cumsum([len(x) for x in parts]), np.concatenate([[0], np.cumsum([n for _, n in cuts])])
        out = []
        for s, start, end, edits in self._matches(b"".join([*parts, data[at:]])):
            moved = int(gone[np.searchsorted(seams, start, "right")])
            out.append((s, start + moved, end + moved, edits))
        return out

    def _bands(self, own: np.ndarray, place: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and bands of diagonals with as many places as a match needs. Bands are edits + 1 wide; each
        is counted with the next.

        Places of one gram at equal distances are one row (first, last, step), those of a segment one stretch: how many
        of the places reach a band of a stretch is then a quotient, so that a run of one character costs its bands."""
        begin = np.ones(len(place), bool)
        begin[1:] = (gap[1:] < 0) | ((gap[1:] != gap[:-1]) & (gap[:-1] >= 0))
        first = np.flatnonzero(begin)
        final = np.append(first[1:], len(place)) - 1
        step = np.where(final > first, gap[final], 1)
        lo, hi = np.searchsorted(self.grams, own[first]), np.searchsorted(self.grams, own[first], "right")
        n, found = hi - lo, []
        weight = (self.cost[hi] - self.cost[lo] + n * ((place[final] - place[first]) // (int(self.edits.min()) + 1))).cumsum()
        for part in np.split(np.arange(len(first)), np.searchsorted(weight, np.arange(PIECE, int(weight[-1]), PIECE))):
            m = n[part]
            entry = np.repeat(lo[part] - (m.cumsum() - m), m) + np.arange(m.sum())
            row = np.repeat(part, m)
            s, a, z, d = self.of[entry], place[first[row]], place[final[row]], step[row]
            width = self.edits[s] + 1
            low, high = (a - self.upto[entry]) // width, (z - self.at[entry]) // width
            m = high - low + 1
            k = np.repeat(np.arange(len(entry)), m)
            band = np.repeat(low - (m.cumsum() - m), m) + np.arange(m.sum())
            left = np.maximum(band * width[k] + self.at[entry][k], a[k])
            right = np.minimum((band + 1) * width[k] - 1 + self.upto[entry][k], z[k])
            held = (right - a[k]) // d[k] + (a[k] - left) // d[k] + 1
            keys, at = np.unique(s[k] * BANDS + band + BANDS // 2, return_inverse=True)
            found.append((keys, np.bincount(at, np.maximum(held, 0), len(keys)).astype(np.int64)))
        keys, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([x for _, x in found]), len(keys)).astype(np.int64)
        both = counts.copy()
        both[:-1] += np.where(np.diff(keys) == 1, counts[1:], 0)
        keys = keys[both >= self.need[keys // BANDS]]
        return keys // BANDS, keys % BANDS - BANDS // 2

    def _verified(self, data: bytes, segment: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least edits in each band, and where that match ends. 0xFF is no byte of UTF-8: it pads the text."""
        edits, ends = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
        pad = max(self.reach, 8) * 5
        text = np.frombuffer(b"\xff" * pad + data + b"\xff" * pad, np.uint8)
        sizes = np.asarray([len(s) for _, s, _, _ in self.segments], np.int64)[segment]
        for size, e in (divmod(x, BANDS) for x in np.unique(sizes * BANDS + self.edits[segment]).tolist()):
            rows = np.flatnonzero((sizes == size) & (self.edits[segment] == e))
            edits[rows] = e + 1
            rows = rows[self._lettered(text, segment[rows], band[rows], size, e, pad)]
            for at in range(0, len(rows), TOGETHER):
                own = rows[at : at + TOGETHER]
                start = band[own] * (e + 1) - e
                regions = text[(start + pad)[:, None] + np.arange(size + 4 * e)]
                letters, which = self._letters(segment[own])
                edits[own], end = aligned(letters[which], regions, e)
                ends[own] = start + end
        return edits, ends

    def _letters(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, which = np.unique(segment, return_inverse=True)
        return np.stack([np.frombuffer(self.segments[s][1], np.uint8) for s in known.tolist()]), which

    def _lettered(self, text: np.ndarray, segment: np.ndarray, band: np.ndarray, size: int, e: int, pad: int) -> np.ndarray:
        """Which bands may hold their segment by its letters alone: each that the text there lacks costs an edit.
        Neighbouring bands of a segment are looked at together."""
        near, kinds, keep = 16, 64, []
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(segment) != 0) | (np.diff(band // near) != 0)]))
        size_of = np.diff(np.append(edge, len(segment)))
        for at in range(0, len(edge), TOGETHER):
            own = edge[at : at + TOGETHER]
            start = band[own] * (e + 1) - e + pad
            regions = text[start[:, None] + np.minimum(np.arange(size + 4 * e + (near - 1) * (e + 1)), (len(text) - 1 - start)[:, None])]
            held = np.bincount((np.arange(len(own))[:, None] * kinds + regions % kinds).ravel(), minlength=len(own) * kinds).reshape(-1, kinds)
            letters, which = self._letters(segment[own])
            wanted = np.bincount((np.arange(len(letters))[:, None] * kinds + letters % kinds).ravel(), minlength=len(letters) * kinds).reshape(-1, kinds)
            keep.append(np.maximum(wanted[which] - held, 0).sum(1) <= e)
        return np.repeat(np.concatenate(keep), size_of)


def indexes(benchmark: DataFrame, ratio: float, segment: int, least: int, block_bytes: int):
    """Broadcast indexes, each of a block of the benchmark of about `block_bytes` at most."""
    sc, blocks = benchmark.sparkSession.sparkContext, max(1, math.ceil(total_bytes(benchmark) / block_bytes))
    for k in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]
        yield sc.broadcast(Index(items, ratio, segment, least)), k + 1 < blocks


def best_matches(index: Index, texts: list[str | None], chars: int = 2_000_000) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By (place in texts, item): edits, start and length of the match of least edits."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    first = 0
    while first < len(texts):
        upto, size = first, 0
        while upto < len(texts) and (upto == first or size < chars):
            size += len(texts[upto] or "")
            upto += 1
        parts = [folded(t) for t in texts[first:upto]]
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        for s, start, end, edits in index.matches(b"\0".join(parts)):
            k = int(np.searchsorted(starts, (start + end) // 2, "right")) - 1
            key, new = (first + k, index.segments[s][0]), (edits, max(0, int(start - starts[k])), end - start)
            best[key] = min(best.get(key, new), new)
        for k, part in enumerate(parts):
            for item, start, end in index.whole(part):
                key, new = (first + k, item), (0, start, end - start)
                best[key] = min(best.get(key, new), new)
        first = upto
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.08, segment: int = 96, least: int = 40, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, start, length, edits: a row for each document and item that match, with the match of least
    edits (start and length in bytes of the folded text)."""

    def against(index) -> DataFrame:
        def find(batches):
            worker_cache("decontamination")
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[k], item, start, length, edits) for (k, item), (edits, start, length) in sorted(best_matches(index.value, batch.column(1).to_pylist()).items())]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "length", "edits"])

        return docs.select("doc_id", "text").mapInArrow(find, MATCHES)

    found = []
    for index, more in indexes(benchmark, ratio, segment, least, block_bytes):
        found.append(against(index))
        if more or len(found) > 1:  # the next index takes its place
            found[-1] = written(found[-1])
            index.destroy()
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.08, segment: int = 96, least: int = 40, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without a match, all columns kept."""
    schema = docs.schema

    def without(index):
        def keep(batches):
            worker_cache("decontamination")
            for batch in batches:
                found = {k for k, _ in best_matches(index.value, batch.column("text").to_pylist())}
                yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

        return keep

    for index, more in indexes(benchmark, ratio, segment, least, block_bytes):
        docs = docs.mapInArrow(without(index), schema)
        if more:  # the next index takes its place
            docs = written(docs)
            index.destroy()
    return docs
