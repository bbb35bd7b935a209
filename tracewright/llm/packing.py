"""Best-fit packing by bin completion with branch and bound.

Texts are encoded and cut into pieces of at most `capacity` tokens (only longer documents are cut). Packing depends on
lengths alone, so the search runs on the histogram of piece lengths: at most `capacity` numbers, whatever the corpus.
Around the largest length left, the search enumerates fillings of the remaining room, largest first, that no other
dominates (once a length closes a filling, shorter ones in its place are skipped), cuts branches whose waste can't beat
the best-fit incumbent, and stops at a filling without waste or at a bound on steps, keeping the incumbent. The filling is
then used as many times as its lengths allow, which uses one length up, so there are about as many searches as lengths.

Pieces get numbers within their length by counting in each task and prefix sums over the tasks (no length is gathered
in one task), and the number says which filling, copy and place is theirs.

Defined results: a null text is empty, and is its end id alone; rows that repeat are packed each; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import written
from tracewright.llm.encoding import batches, encoder, narrow

#: Bytes of units that a worker keeps, characters encoded at once, rows sent to a worker at once: a stage of a pipeline
#: shares its executor with what stages before it have left there.
MEMO_BYTES, CHARS, BATCH_ROWS = 40_000_000, 1_000_000, 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, n long"


def complete(lengths: list[int], counts: dict[int, int], room: int, steps: int) -> tuple[int, ...]:
    """Lengths (ascending, with counts) that fill `room` with the least waste found in so many steps."""
    best: tuple[int, ...] = ()
    best_waste, left, smallest = room, steps, lengths[0] if lengths else 1
    filled = [0]  # the most that the first so many lengths fill
    for n in lengths:
        filled.append(filled[-1] + n * counts[n])

    def search(room: int, upto: int, chosen: tuple[int, ...]) -> None:
        nonlocal best, best_waste, left
        if room < best_waste:
            best, best_waste = chosen, room
        at = min(bisect_right(lengths, room), upto) - 1
        while at >= 0 and best_waste and left > 0 and room - filled[at + 1] < best_waste:
            length = lengths[at]
            most = min(counts[length], room // length)
            for k in range(most, 0, -1):
                if room - k * length - filled[at] >= best_waste:
                    break
                left -= 1
                search(room - k * length, at, chosen + (length,) * k)
                if not best_waste or left <= 0:
                    return
            # Once a length closes the filling, shorter ones that close it too only waste more: it dominates them.
            closes = most and room - most * length < smallest
            at = min(at, bisect_right(lengths, room - smallest)) - 1 if closes and most == 1 else at - 1

    search(room, len(lengths), ())
    return best


def plan(histogram: dict[int, int], capacity: int, steps: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, times) for all that the histogram counts."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, out = sorted(counts), []
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        rest = complete(lengths if counts[largest] else lengths[:-1], counts, capacity - largest, steps)
        counts[largest] += 1
        filling = (largest, *rest)
        used = {n: filling.count(n) for n in filling}
        times = min(counts[n] // k for n, k in used.items())
        out.append((filling, times))
        for n, k in used.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    return out


def places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length's numbers from `low` on: the first sequence, the sequences, and the place in each of them."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for length in filling:
            low = taken.get(length, 0)
            rows.append((length, low, sequence, offset))
            taken[length] = low + times
            offset += length
        sequence += times
    rows.sort()
    names = ("length", "low", "sequence", "offset")
    return {n: np.asarray([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int, id_width: int | None) -> DataFrame:
    """A row for each piece, written to the shared folder, with its ids if these have a width; `n` counts the pieces
    of its length before it within the task `part`."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def cut(rows):
        encode, part = encoder(vocab, MEMO_BYTES), TaskContext.get().partitionId()
        seen: dict[int, int] = {}  # by length
        end = np.asarray([end_id], np.uint32)
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts, CHARS):
                found, starts, stops = encode.flat(texts[a:b])
                out, kept = [], []
                for doc_id, x, y in zip(ids[a:b], starts.tolist(), stops.tolist(), strict=True):
                    for k, at in enumerate(range(0, y - x + 1, capacity)):
                        own = found[x + at : min(y, x + at + capacity)]
                        if y - x - at < capacity:
                            own = np.concatenate([own, end])
                        n = seen.get(len(own), 0)
                        seen[len(own)] = n + 1
                        out.append((doc_id, k, at, len(own), zlib.crc32(own.tobytes()), part, n))
                        if id_width:
                            kept.append(narrow(own, id_width).tobytes())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if id_width else [])], [*names, *(["ids"] if id_width else [])])

    return written(docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if id_width else "")), compression="zstd", batch_rows=BATCH_ROWS)


def packed(docs: DataFrame, vocab: str, *, capacity: int = 4096, end_id: int = 1, steps: int = 3000, with_ids: bool = True, id_width: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, unless turned off, ids (little-endian, of
    `id_width` bytes each; an id that doesn't fit is an error): a row for each piece. The driver sees the counts of
    the lengths, at most `capacity` numbers; pieces move once, to the first number of their length and task."""
    spark = docs.sparkSession
    cut = pieces(docs, vocab, capacity, end_id, id_width if with_ids else None)
    by_part = written(cut.groupBy("length", "part").agg(F.count("*").alias("_m")))
    histogram = {r["length"]: r["_m"] for r in by_part.groupBy("length").agg(F.sum("_m").alias("_m")).collect()}
    place = spark.sparkContext.broadcast(places(plan(histogram, capacity, steps)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])

    def put(batches):
        p = place.value
        wide = int(p["low"].max() + 1) if len(p["low"]) else 1
        at_key = p["length"] * wide + p["low"]
        for batch in batches:
            number, length = batch.column("_number").to_numpy(), batch.column("length").to_numpy()
            k = np.searchsorted(at_key, length * wide + np.minimum(number, wide - 1), "right") - 1
            found = (p["sequence"][k] + number - p["low"][k], p["offset"][k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *map(pa.array, found)], [*columns, "sequence_id", "offset"])

    numbered = cut.join(first, ["length", "part"]).select(*columns, (F.col("_first") + F.col("n")).alias("_number"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return numbered.mapInArrow(put, schema)
