"""N-gram Jaccard join with Bayesian candidate pruning: which documents share most of their word shingles.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a MinHash signature. Documents with equal sets
   are one class and are joined once.
2. Signatures are cut into bands; classes that agree on a band are candidates. At the threshold, a pair is missed with
   probability (1 - t ** rows) ** bands, 3e-6 as set here, and far less above it.
3. Within a band's bucket, pairs are compared on ever more MinHash values; a pair goes once the posterior probability
   (uniform prior, m of n values equal) that its similarity reaches the threshold falls below `tolerance`. What is left
   gives the bucket's edges, one for each member: to the least of those it leads to. A bucket of more than `block`
   members is one star, without comparisons: its members meet below anyway. Connected components of these edges, over
   all buckets, hold every linked pair.
4. Within a component pairs are pruned again and what survives is verified exactly on the shingle sets; each class gets
   its number of links, and edges to the least it links to give the final classes, again by connected components.

Hot components (more than `block` members, or more shingles than a task may hold) are not compared pair by pair where
that can be helped. Their center C is the set of shingles that more than half of the members have. A member keeps only
its difference D to the center and the weight w = |C - S| + t |S - C|. For two members

    J >= t   if and only if   (1 + t) |D1 & D2| >= w1 + w2 - (1 - t) |C|

so two members whose weights add up to at most (1 - t) |C| are linked whatever they hold: these pairs are counted from
the histogram of weights, and the member of least weight is their hub, one edge for each. The others meet in pairs of
blocks, dealt in order of weight; a member goes to a block only if the condition can hold for some member there and
isn't certain for all. Only these pairs cost comparisons, and they carry differences, not texts.

Defined results: texts of fewer than five words are one shingle, of all their words; texts without words, null ones
included, link to nothing. Rows that share a doc_id are joined like others; their class is the least doc_id in it. An
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import STEP, mixed, rolling, word_hashes, words, worker_cache, written

SIGNED = "set_id long, n_shingles long, signature binary, bands array<long>"
#: Bounds of what a task holds at a time: pairs compared, shingles of two blocks, hashes sorted together.
PAIRS, SHINGLES, HASHES = 1 << 21, 4_000_000, 1 << 20
#: Weights are sums of integers and multiples of the threshold, far from one another by this measure.
EPS = 1e-6


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes(words(text))
    if not len(h):
        return h
    return np.unique(rolling(h, size) if len(h) >= size else rolling(h, len(h)))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (a[:, None] * x[None, at : at + 4096] + b[:, None]).min(1), out)
    return out


def set_id(shingles: np.ndarray) -> int:
    return int((mixed(shingles).sum(dtype=np.uint64) ^ np.uint64(len(shingles))).view(np.int64))


def keep_from(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For each count n of values compared, the least number of equal ones that a pair needs to stay.

    The posterior of the similarity is Beta(m + 1, n - m + 1); P(s >= t) is a binomial sum.
    """
    out = []
    for n in steps:
        for m in range(n + 1):
            above = sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
            if above >= tolerance:
                out.append(m)
                break
    return out


def survivors(sig: np.ndarray, groups: list[tuple[int, int]], own: np.ndarray, steps: list[int], least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, within groups (runs from, to), whose signatures stay above the bounds.

    A group with members of two blocks compares each of the one with each of the other.
    """
    small = np.zeros(len(sig) + 1, np.int64)  # where the small group of a row ends
    found: list[tuple[np.ndarray, np.ndarray]] = []
    longest = 0

    def refine(i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> None:
        for start in range(0, len(i), HASHES // 8):
            a, b, count = (v[start : start + HASHES // 8] for v in (i, j, equal.astype(np.int32)))
            for at, upto, need in zip(steps, steps[1:], least[1:], strict=False):
                count = count + (sig[a, at:upto] == sig[b, at:upto]).sum(1, dtype=np.int32)
                stay = count >= need
                a, b, count = a[stay], b[stay], count[stay]
            found.append((a, b))

    for start, end in groups:
        if end - start <= 24 and own[start:end].min() == own[start:end].max():
            small[start:end] = end
            longest = max(longest, end - start)
            continue
        x = np.arange(start, end)
        two = own[start:end] != own[start]
        x, y = (x[~two], x[two]) if two.any() else (x, x)
        equal = np.zeros((len(x), len(y)), np.uint8)
        for k in range(steps[0]):
            equal += sig[x, k, None] == sig[None, y, k]
        stay = equal >= least[0]
        i, j = np.nonzero(stay if two.any() else np.triu(stay, 1))
        refine(x[i], y[j], equal[i, j])
    for gap in range(1, longest):
        i = np.flatnonzero(small[:-1] > np.arange(len(sig)) + gap)
        equal = (sig[i, : steps[0]] == sig[i + gap, : steps[0]]).sum(1)
        i, equal = i[equal >= least[0]], equal[equal >= least[0]]
        refine(i, i + gap, equal)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    return i, j


def whole_groups(batches, keys: list[str], rows: int = 4000, size: int = 32_000_000):
    """Tables of whole groups, and the runs of their rows, from batches sorted by the keys. A table has one group, or
    more while they stay below `rows` and PAIRS."""

    def tables(table: pa.Table, runs: list[tuple[int, int]]):
        first = pairs = 0
        for k, (start, end) in enumerate(runs):
            pairs += (end - start) ** 2
            if k + 1 == len(runs) or end - runs[first][0] >= rows or pairs + (runs[k + 1][1] - end) ** 2 > PAIRS:
                base = runs[first][0]
                yield table.slice(base, end - base), [(x - base, y - base) for x, y in runs[first : k + 1]]
                first, pairs = k + 1, 0

    kept: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        kept = now if kept is None else pa.concat_tables([kept, now])
        if kept.num_rows >= rows or kept.nbytes >= size:
            runs = runs_of(kept, keys)
            if len(runs) > 1:
                yield from tables(kept, runs[:-1])
                kept = kept.slice(runs[-1][0])
    if kept is not None and kept.num_rows:
        yield from tables(kept, runs_of(kept, keys))


def runs_of(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], table.num_rows], strict=True))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of edges that join all that the edges join."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for start in range(0, len(i), HASHES // 8):
        for k, (x, y) in enumerate(zip(i[start : start + HASHES // 8].tolist(), j[start : start + HASHES // 8].tolist(), strict=True), start):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
    return kept


def least_joined(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge for each row that the pairs (i, j) of rows join to a lesser id: its id, and the least it leads to."""
    kept = forest(len(ids), i, j)
    i, j = i[kept], j[kept]
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    i, j, label = rank[i], rank[j], np.arange(len(ids))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label < np.arange(len(ids)))
    return ids[order[own]], ids[order[label[own]]]


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whole groups in a task, one after the other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) lead to, by passing on labels and following them."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        over = labels.select(F.col("node").alias("to"), F.col("label").alias("over"))
        labels = written(lower.join(over, "to").select("node", F.least("to", "over").alias("label"), "was"))
        if labels.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")


def dealt(weights, threshold: float, block: int):
    """Of one hot component, by weight (rows w, n members, their copies, sum and maximum of their differences, size of
    the center): how many rows are linked for sure, the blocks the members are dealt to, and the blocks that they must
    meet. As many rows come out as there are different weights."""
    import pandas as pd

    v = weights.sort_values("w", ignore_index=True)
    w, n, copies, d, most = (v[c].to_numpy() for c in ("w", "n", "copies", "d", "most"))
    bound = (1 - threshold) * float(v["n_center"].iloc[0])
    sums = np.concatenate([[0], copies.cumsum()])
    certain = sums[np.searchsorted(w, bound - w + EPS, "right")]
    first, blocks, ranges = [], [], []  # ranges: least weight, greatest weight, greatest difference of each block
    members = held = 0
    for k in range(len(w)):
        own = int(max(1, math.ceil(n[k] * 1.25 / block) if n[k] > block else 1, min(n[k], math.ceil(d[k] * 2 / SHINGLES))))
        if own == 1 and ranges and members and members + n[k] <= block and held + d[k] <= SHINGLES:
            low, _, largest = ranges[-1]
            ranges[-1] = (low, w[k], max(largest, most[k]))
            members, held = members + n[k], held + d[k]
        else:
            ranges += [(w[k], w[k], most[k])] * own
            members, held = (n[k], d[k]) if own == 1 else (0, 0)
        first.append(len(ranges) - own)
        blocks.append(own)
    low, high, largest = (np.asarray(c, float) for c in zip(*ranges, strict=True))
    meets = [np.flatnonzero((x + high > bound + EPS) & ((1 + threshold) * np.minimum(m, largest) + EPS >= x + low - bound)).tolist() for x, m in zip(w, most, strict=True)]
    return pd.DataFrame({"component": v["component"], "w": w, "certain": certain, "pairs_with_itself": 2 * w <= bound + EPS, "first": first, "blocks": blocks, "meets": meets})


def joined(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, tolerance: float = 1e-6, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, set_id; set_id is null where a row links to nothing) and the classes of equal sets (set_id,
    first_id, copies, class_key that linked ones share, class_id, n_links)."""
    values = bands * rows
    steps = list(range(16, values + 1, 16))
    least = keep_from(threshold, tolerance, steps)

    def sign(batches):
        worker_cache("nearjoin")
        a, b = permutations(values)
        weights = np.arange(3, 3 + 2 * rows, 2, dtype=np.uint64) * np.uint64(STEP)
        for batch in batches:
            ids, sets, sizes, signs, keys = batch.column(0).to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, size)
                if not len(s) or doc_id is None:
                    sets.append(None)
                    sizes.append(None)
                    signs.append(None)
                    keys.append(None)
                    continue
                sig = signature(s, a, b)
                sets.append(set_id(s))
                sizes.append(len(s))
                signs.append(sig.tobytes())
                keys.append(mixed(mixed((sig.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * weights).sum(1, dtype=np.uint64)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "set_id", "n_shingles", "signature", "bands"])

    signed = written(docs.select("doc_id", "text").mapInArrow(sign, f"doc_id long, {SIGNED}"))
    # A class of equal sets: its least doc_id, how many rows, and one signature.
    classes = written(signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))

    def signatures(table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, values)

    def bucket_edges(batches):
        worker_cache("nearjoin")
        for table, groups in whole_groups(batches, ["band", "key"]):
            ids = table.column("set_id").to_numpy()
            i, j = survivors(signatures(table), groups, np.zeros(len(ids), np.int32), steps, least)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_joined(ids, i, j)], ["a", "b"])

    light = classes.select("set_id", F.posexplode("bands").alias("band", "key"))
    # Buckets with the same members, in other bands, say nothing new.
    distinct = light.groupBy("band", "key").agg(F.count("*").alias("_m"), F.min("set_id").alias("_least"), F.bit_xor(F.xxhash64("set_id")).alias("_who"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "set_id"), 20)).alias("_sum")).where("_m > 1").groupBy("_m", "_who", "_sum").agg(F.min_by(F.struct("band", "key", "_least"), F.struct("band", "key")).alias("_b"))
    shared = written(light.join(distinct.select("_b.*", "_m"), ["band", "key"]))
    stars = shared.where((F.col("_m") > block) & (F.col("set_id") > F.col("_least"))).select(F.col("set_id").alias("a"), F.col("_least").alias("b"))
    candidates = shared.where(F.col("_m") <= block).select("band", "key", "set_id").join(classes.select("set_id", "signature"), "set_id")
    edges = written(grouped(candidates, ["band", "key"]).mapInArrow(bucket_edges, "a long, b long").unionByName(stars).distinct())
    groups = components(edges)

    # One set for each class in a component, made from one of its texts.
    known = written(groups.withColumnRenamed("node", "set_id").join(classes.select("set_id", "first_id", "copies", "n_shingles", "signature"), "set_id"))
    sizes = known.groupBy("component").agg(F.count("*").alias("_m"), F.sum("n_shingles").alias("_s"))
    sizes = written(sizes.select("component", F.when((F.col("_m") > block) | (F.col("_s") > SHINGLES), F.col("_m")).otherwise(0).alias("_hot")))

    def own_set(batches):
        worker_cache("nearjoin")
        for batch in batches:  # rows that share a doc_id may hold other texts
            found = [(k, s.tobytes()) for t, k in zip(batch.column("text").to_pylist(), batch.column("set_id").to_pylist(), strict=True) if len(s := shingle_set(t, size)) and set_id(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["set_id", "shingles"])

    sets = docs.select("doc_id", "text").join(known.select(F.col("first_id").alias("doc_id"), "set_id"), "doc_id").select("set_id", "text").mapInArrow(own_set, "set_id long, shingles binary")
    # Only rows that repeat a doc_id give a set twice.
    full = written(known.drop("first_id", "n_shingles").join(sizes, "component").join(sets, "set_id").dropDuplicates(["set_id"]), compression="none")
    cold = full.where("_hot = 0").select("component", "set_id", "copies", "signature", F.col("shingles").alias("diff"), (threshold * F.octet_length("shingles") / 8).alias("w"), F.lit(0).alias("own"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0.0).alias("bound"))

    def shingle_counts(batches):
        worker_cache("nearjoin")
        for batch in batches:
            component = batch.column(0).to_numpy()
            for c in np.unique(component):
                x, n = np.unique(np.concatenate([np.frombuffer(s, np.int64) for s in batch.column(1).filter(pa.array(component == c)).to_pylist()]), return_counts=True)
                for at in range(0, len(x), HASHES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[at : at + HASHES]), c)), pa.array(x[at : at + HASHES]), pa.array(n[at : at + HASHES])], ["component", "shingle", "n"])

    hot = full.where("_hot > 0")
    many = hot.select("component", "shingles").mapInArrow(shingle_counts, "component long, shingle long, n long").groupBy("component", "shingle").agg(F.sum("n").alias("n"))
    # At most twice as large as a member is on average.
    centers = many.join(sizes.where("_hot > 0"), "component").where(F.col("n") * 2 > F.col("_hot")).groupBy("component").agg(F.collect_list("shingle").alias("center"))
    salts = F.ceil(F.col("_hot") / block).cast("int")
    center_rows = sizes.where("_hot > 0").join(centers, "component", "left").select("component", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("set_id"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("signature"), F.coalesce("center", F.array().cast("array<long>")).alias("center"), F.lit(None).cast("binary").alias("shingles"))
    member_rows = hot.select("component", F.pmod(F.xxhash64(F.lit(7), "set_id"), salts).cast("int").alias("salt"), "set_id", "copies", "signature", F.lit(None).cast("array<long>").alias("center"), "shingles")

    def differences(batches):
        worker_cache("nearjoin")
        center = np.empty(0, np.uint64)
        for batch in batches:
            out, member = [], batch.column("set_id").is_valid().to_pylist()
            for k, shingles in enumerate(batch.column("shingles").to_pylist()):
                if not member[k]:  # the center comes before the members of its salt
                    center = np.sort(np.asarray(batch.column("center")[k].as_py(), np.int64).view(np.uint64))
                    continue
                s = np.frombuffer(shingles, np.uint64)
                lost, new = np.setdiff1d(center, s, assume_unique=True), np.setdiff1d(s, center, assume_unique=True)
                out.append((np.sort(np.concatenate([lost, new])).tobytes(), round(len(lost) + threshold * len(new), 6), len(center)))
            own = batch.filter(batch.column("set_id").is_valid())
            diff, w, n = (pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.binary(), pa.float64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("component", "set_id", "copies", "signature")], diff, w, n], ["component", "set_id", "copies", "signature", "diff", "w", "n_center"])

    placed = center_rows.unionByName(member_rows).repartition("component", "salt").sortWithinPartitions("component", "salt", F.col("set_id").asc_nulls_first())
    apart = written(placed.mapInArrow(differences, "component long, set_id long, copies long, signature binary, diff binary, w double, n_center long"), compression="none")
    d = F.octet_length("diff") / 8
    weights = apart.groupBy("component", "w").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.sum(d).alias("d"), F.max(d).alias("most"), F.first("n_center").alias("n_center"))
    plan = written(weights.groupBy("component").applyInPandas(lambda pdf: dealt(pdf, threshold, block), "component long, w double, certain long, pairs_with_itself boolean, first int, blocks int, meets array<int>"))
    bound = (1 - threshold) * F.col("n_center")
    planned = apart.join(plan, ["component", "w"]).withColumn("own", F.col("first") + F.pmod(F.xxhash64(F.lit(5), "set_id"), F.col("blocks")).cast("int"))
    met = planned.select("component", "set_id", "copies", "signature", "diff", "w", "own", F.explode("meets").alias("_other"), bound.alias("bound"))
    met = met.select("component", "set_id", "copies", "signature", "diff", "w", "own", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "bound")
    certain = planned.select("set_id", (F.col("certain") - F.when(F.col("pairs_with_itself"), F.col("copies")).otherwise(0)).alias("n")).where("n > 0")
    hubs = apart.groupBy("component").agg(F.min(F.struct("w", "set_id")).alias("_hub"))
    spokes = apart.join(hubs, "component").where((F.col("w") + F.col("_hub.w") <= bound + EPS) & (F.col("set_id") != F.col("_hub.set_id"))).select(F.col("set_id").alias("a"), F.col("_hub.set_id").alias("b"), F.lit(0).cast("long").alias("n"))

    def links(batches):
        worker_cache("nearjoin")
        for table, groups in whole_groups(batches, ["component", "lo", "hi"], 1000):
            ids, copies, w, bound = (table.column(c).to_numpy() for c in ("set_id", "copies", "w", "bound"))
            own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
            # Where one of two blocks is empty, the other's members meet in a group of their own.
            groups = [(a, b) for a, b in groups if lo[a] == hi[a] or own[a:b].min() < own[a:b].max()]
            i, j = survivors(signatures(table), groups, own, steps, least)
            rest = w[i] + w[j] > bound[i] + EPS  # the others are counted already
            i, j = i[rest], j[rest]
            common = np.zeros(len(i), np.int64)
            group = np.searchsorted([g[1] for g in groups], i, "right")
            for g in np.unique(group):
                start, end = groups[g]
                at = np.flatnonzero(group == g)
                diffs = [np.frombuffer(s, np.uint64) for s in table.column("diff").slice(start, end - start).to_pylist()]
                common[at] = intersections(diffs, i[at] - start, j[at] - start)
            ok = (1 + threshold) * common + EPS >= w[i] + w[j] - bound[i]
            i, j = i[ok], j[ok]
            n = np.zeros(table.num_rows, np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            at, (a, b) = np.flatnonzero(n), least_joined(ids, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((ids[at], a), (ids[at], b), (n[at], np.zeros(len(a), np.int64)))], ["a", "b", "n"])

    found = grouped(cold.unionByName(met), ["component", "lo", "hi"]).mapInArrow(links, "a long, b long, n long")
    found = written(found.unionByName(spokes).unionByName(certain.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), "n")))
    counted = found.where("a = b").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("_links"))
    final = components(found.where("a <> b")).withColumnRenamed("node", "set_id")
    least_id = final.join(classes, "set_id").groupBy("component").agg(F.min("first_id").alias("class_id"))
    known = classes.select("set_id", "first_id", "copies").join(final.join(least_id, "component"), "set_id", "left").join(counted, "set_id", "left")
    known = known.select("set_id", "first_id", F.coalesce("component", "set_id").alias("class_key"), F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"))
    return signed.select("doc_id", "set_id"), known


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of all that links join) and n_links (other rows with similarity at or above
    the threshold), a row for each row of docs; options as for joined()."""
    rows, classes = joined(docs, **options)
    return rows.join(classes, "set_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 8192) -> np.ndarray:
    """|set i & set j| for each pair: one by one if few, else as products of 0/1 blocks over the shingles in use."""
    if len(i) <= 4 * len(sets):
        return np.asarray([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    total = np.zeros((len(sets), len(sets)), np.float32)
    # Hashes are uniform, so ranges of them hold about equally many.
    ranges = math.ceil(sum(map(len, sets)) / HASHES)
    edges = np.asarray([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for r in range(ranges):
        flat = np.concatenate([s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)])
        if not len(flat):
            continue
        owner = np.repeat(np.arange(len(sets)), [c[r + 1] - c[r] for c in cuts])
        _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
        several = n > 1  # what only one set holds is in no intersection
        if not several.any():
            continue
        owner, column = owner[several[column]], (several.cumsum() - 1)[column[several[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1, columns):
            lo, hi = np.searchsorted(column, (start, start + columns))
            part = np.zeros((len(sets), columns), np.float32)
            part[owner[lo:hi], column[lo:hi] - start] = 1
            total += part @ part.T
    return total[i, j].astype(np.int64)


def one_of_each(docs: DataFrame, *, size: int = 5, **options) -> DataFrame:
    """The rows of docs that stay, all columns kept: of each class one row, of the least doc_id; every row without
    words and every row with a null doc_id, as these link to nothing."""
    rows, classes = joined(docs, size=size, **options)
    keep = classes.groupBy("class_key").agg(F.min(F.struct("first_id", "set_id")).alias("_k")).select(F.col("_k.first_id").alias("doc_id"), F.col("_k.set_id").alias("_set"))
    keep = written(keep.unionByName(rows.where("set_id is null and doc_id is not null").select("doc_id", F.lit(None).cast("long").alias("_set")).distinct()))
    null_ids = docs.where("doc_id is null")
    # A doc_id of several rows says not which of them stays; where there is one, its rows are told apart by their sets.
    again = written(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs.join(keep.select("doc_id"), "doc_id").select(docs.columns).unionByName(null_ids)

    def with_set(batches):
        worker_cache("nearjoin")
        for batch in batches:
            own = [set_id(s) if len(s := shingle_set(t, size)) else None for t in batch.column("text").to_pylist()]
            yield batch.append_column("_set", pa.array(own, pa.int64()))

    several = docs.join(again, "doc_id", "left_semi").mapInArrow(with_set, StructType([*docs.schema, StructField("_set", LongType())])).withColumnRenamed("doc_id", "_id")
    several = several.join(keep.withColumnRenamed("_set", "_kept"), (F.col("_id") == F.col("doc_id")) & F.col("_set").eqNullSafe(F.col("_kept"))).drop("doc_id", "_kept").withColumnRenamed("_id", "doc_id")
    one = Window.partitionBy("doc_id", "_set").orderBy(F.xxhash64("text"))
    several = several.withColumn("_n", F.row_number().over(one)).where("_n = 1 or _set is null")
    single = docs.join(keep.select("doc_id").join(again, "doc_id", "left_anti"), "doc_id")
    return single.select(docs.columns).unionByName(several.select(docs.columns)).unionByName(null_ids)
