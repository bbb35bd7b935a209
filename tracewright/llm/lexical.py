"""Ranked lexical search for a set of items over all documents, by two trees that are searched together.

Scores are saturated term counts times whole-number weights (BM25's form in integers), so every sum is exact. Each text
becomes a sparse vector over the items' terms once. Items, and documents in batches of a task, form trees of three
levels whose nodes hold the greatest value of each coordinate. What a pair of nodes can score at most is the product of
these; a pair below the weakest kth score among its items is left out with all that hangs below it, else its children
meet, down to single pairs, whose products are the scores themselves.

Where to begin is found first: the items' kth scores over a hashed share of the documents (1 in 32) bound the final ones
from below, so what tasks hand over doesn't grow with their number. All documents are searched after that.

Items travel in blocks of at most 4 MB of text, one block at a time, and meet in branches of at most 4,096 different
terms, which bounds the dense arrays. Nothing but counts of the block's terms and its kth scores comes to the driver.

Defined results: null and empty texts have no terms, score nothing and don't count as documents; an item without terms,
or whose terms no document has, gives no rows; rows that repeat are ranked each, and each row of the items gets its own
ranks; of equal scores a null doc_id comes last; without documents or items there are none. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import worker_cache, written
from tracewright.llm.terms import folding, term_lists

TABLE = folding(digits=True)
BLOCK_BYTES, BRANCH_TERMS, BRANCH_ITEMS = 4 << 20, 4096, 512
#: Documents below a node, and items below a node, from the top level down.
DOC_SPANS, ITEM_SPANS = (64, 8, 1), (16, 4, 1)
#: Numbers in the dense array of a batch of documents.
CELLS = 4 << 20
#: One document in so many tells where to begin.
SHARE = 32
NOWHERE = np.iinfo(np.int64).max


class Items:
    """A block of items: their ids, their terms in order, and each item's counts by term."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        counts = [Counter(t for part in term_lists(r[1], TABLE) for t in part) for r in rows]
        self.terms = sorted(set().union(*counts))
        number = {t: k for k, t in enumerate(self.terms)}
        self.counts = [{number[t]: n for t, n in c.items()} for c in counts]


def blocks(items: DataFrame) -> Iterator[Items]:
    rows, size = [], 0
    for r in items.select("item_id", F.col("text").cast("binary")).orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r[1] or b"") > BLOCK_BYTES:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1] or b"")
    if rows:
        yield Items(rows)


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers of those in the list) and tfs (how often each stands there)."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        own = worker_cache("lexical")
        if own.get("terms") != known.value:
            own["terms"], own["number"] = known.value, {t: k for k, t in enumerate(known.value)}
        number = own["number"].get
        for batch in batches:
            n, keys, counts, ends = [], [], [], [0]
            for raw in batch.column(1):
                found, total = Counter(), 0
                for part in term_lists(raw.as_py(), TABLE):
                    total += len(part)
                    found.update(map(number, part))
                found.pop(None, None)
                n.append(total)
                keys.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(keys))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Branch:
    """A tree of items over the columns of their own terms, the common ones first."""

    def __init__(self, items: list[int], counts: list[dict], df: np.ndarray, weight: np.ndarray):
        used = sorted(set().union(*(counts[k].keys() for k in items)), key=lambda t: (-df[t], t))
        self.columns = np.full(len(df), -1, np.int32)
        self.columns[used] = np.arange(len(used), dtype=np.int32)
        self.weight = weight[used]
        leaf = np.zeros((len(items), len(used)))
        for row, k in enumerate(items):
            leaf[row, self.columns[list(counts[k])]] = list(counts[k].values())
        order = alike(leaf * self.weight)
        self.items = [items[k] for k in order]
        padded = np.zeros((-(-len(items) // ITEM_SPANS[0]) * ITEM_SPANS[0], len(used)))
        padded[: len(items)] = leaf[order]
        # Sums of whole numbers below 2^53 are exact as doubles; whatever could go beyond is reckoned in integers.
        if float(padded.max(0, initial=0) @ self.weight) * 1e6 >= 2**53:
            padded = padded.astype(np.int64)
        self.levels = [padded.reshape(-1, span, padded.shape[1]).max(1) for span in ITEM_SPANS]


def alike(rows: np.ndarray) -> np.ndarray:
    """An order in which rows that share much stand together: halves around two that share little, again and again."""
    if len(rows) <= ITEM_SPANS[1]:
        return np.arange(len(rows))
    size = np.sqrt((rows * rows).sum(1)) + 1e-9
    near = lambda k: rows @ rows[k] / size / size[k]
    far = near(0).argmin()
    side = np.argsort(near(far) - near(near(far).argmin()), kind="stable")
    half = len(rows) // 2
    return np.concatenate([part[alike(rows[part])] for part in (side[:half], side[half:])])


def branches(block: Items, df: np.ndarray, n_docs: int) -> list[Branch]:
    weight = np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.float64)
    # Items of one language have their commonest terms in common.
    order = sorted((k for k, c in enumerate(block.counts) if c), key=lambda k: (sorted(block.counts[k], key=lambda t: (-df[t], t))[:2], k))
    out, some, terms = [], [], set()
    for k in order:
        if some and (len(some) >= BRANCH_ITEMS or len(terms | block.counts[k].keys()) > BRANCH_TERMS):
            out.append(Branch(some, block.counts, df, weight))
            some, terms = [], set()
        some.append(k)
        terms |= block.counts[k].keys()
    return [*out, *([Branch(some, block.counts, df, weight)] if some else [])]


def tops(kept: tuple, score: np.ndarray, doc: np.ndarray, none: np.ndarray, k: int) -> tuple:
    """The k best of what is kept and what comes, by score, then by doc_id (null last)."""
    score, doc, none = (np.concatenate(x) for x in zip(kept, (score, doc, none), strict=True))
    order = np.lexsort((doc, none, -score))[:k]
    return score[order], doc[order], none[order]


def met(branch: Branch, docs: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Which pairs (item, row of docs) may still matter, their scores, and how many pairs of nodes were bounded.

    floor: what each item (padded ones: more than anything) has to reach."""
    n = -(-len(docs) // DOC_SPANS[0]) * DOC_SPANS[0]
    if n > len(docs):
        docs = np.concatenate([docs, np.zeros((n - len(docs), docs.shape[1]), docs.dtype)])
    nodes = [docs]
    for above, span in zip(DOC_SPANS[-2::-1], DOC_SPANS[::-1], strict=False):
        nodes.insert(0, nodes[0].reshape(-1, above // span, docs.shape[1]).max(1))
    alive = np.ones((len(branch.levels[0]), len(nodes[0])), bool)
    work = 0
    for level, (q, d) in enumerate(zip(branch.levels, nodes, strict=True)):
        if level:
            alive = alive.repeat(ITEM_SPANS[level - 1] // ITEM_SPANS[level], 0).repeat(DOC_SPANS[level - 1] // DOC_SPANS[level], 1)
        rows, columns = alive.any(1).nonzero()[0], alive.any(0).nonzero()[0]
        bound = q[rows] @ d[columns].T
        weakest = floor.reshape(len(q), -1).min(1)
        own = alive[np.ix_(rows, columns)] & (bound >= weakest[rows][:, None])
        work += int(alive.sum())
        alive = np.zeros_like(alive)
        alive[np.ix_(rows, columns)] = own
    scores = np.zeros(alive.shape, np.int64)
    scores[np.ix_(rows, columns)] = bound.astype(np.int64)
    return alive, scores, work


def searched(vecs: DataFrame, block: Items, trees: list[Branch], n_docs: int, n_terms: int, floor: list[int], k: int) -> DataFrame:
    """_item (its place in the block), doc_id, score: each task's k best documents of each item that reach its floor."""
    sent = vecs.sparkSession.sparkContext.broadcast((trees, floor))

    def search(batches):
        worker_cache("lexical")
        trees, floor = sent.value
        best = {i: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for t in trees for i in t.items}
        least = {i: max(1, floor[i]) for i in best}
        for batch in batches:
            doc_id, n = batch.column(0), batch.column(1).to_numpy()
            none = doc_id.is_null().to_numpy(zero_copy_only=False)
            doc = doc_id.fill_null(NOWHERE).to_numpy()
            edges = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), np.diff(edges))
            # n * N may pass 64 bits where N is a whole corpus: Python's integers don't.
            m = np.asarray([100 - 25 + (25 * x * n_docs) // n_terms for x in n.tolist()], np.int64)
            full = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            for tree in trees:
                column = tree.columns[term]
                own = column >= 0
                at, column, value = row[own], column[own], full[own] * tree.weight[column[own]].astype(np.int64)
                if not len(at):
                    continue
                # Documents with the same commonest term stand together, those that may score much first.
                total = np.bincount(at, value, len(n))
                first = np.full(len(n), len(tree.weight), np.int64)
                np.minimum.at(first, at, column)
                order = np.lexsort((-total, first))
                order = order[total[order] > 0]
                place = np.full(len(n), -1)
                place[order] = np.arange(len(order))
                at = place[at]
                by = np.argsort(at, kind="stable")
                at, column, value = at[by], column[by], value[by]
                size = max(8, CELLS // len(tree.weight))
                for start in range(0, len(order), size):
                    rows = order[start : start + size]
                    a, b = np.searchsorted(at, (start, start + len(rows)))
                    dense = np.zeros((len(rows), len(tree.weight)), tree.levels[0].dtype)
                    dense[at[a:b] - start, column[a:b]] = value[a:b]
                    need = np.full(len(tree.levels[-1]), np.iinfo(np.int64).max)
                    need[: len(tree.items)] = [least[i] for i in tree.items]
                    alive, scores, _ = met(tree, dense, need)
                    for j in alive.any(1).nonzero()[0].tolist():
                        hit = alive[j, : len(rows)].nonzero()[0]
                        i = tree.items[j]
                        best[i] = tops(best[i], scores[j, hit], doc[rows[hit]], none[rows[hit]], k)
                        if len(best[i][0]) == k:
                            least[i] = max(least[i], int(best[i][0][-1]))
        for i, (score, doc, none) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], ["_item", "doc_id", "score"])

    return vecs.where(F.size("terms") > 0).mapInArrow(search, "_item int, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """_item, doc_id, score, rank of the k best of each item: within 64 shares first, so that no task gets many rows of one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = found.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("_item", "_share").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("_share").withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score over 0."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks(items):
        if not block.terms:
            continue
        vecs = written(vectors(docs, block.terms))
        n_docs, n_terms = vecs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(block.terms), np.int64)
        for t, held in vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
            df[t] = held
        trees = branches(block, df, n_docs)
        share = vecs.where(F.pmod(F.xxhash64("doc_id", "n", "tfs"), F.lit(SHARE)) == 0)
        floor = [0] * len(block.ids)
        for r in best_of(searched(share, block, trees, n_docs, n_terms, floor, k), k).where(F.col("rank") == k).collect():
            floor[r["_item"]] = r["score"]
        found = best_of(searched(vecs, block, trees, n_docs, n_terms, floor, k), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"_item int, item_id {kind}")
        out = out.unionByName(found.join(names, "_item").select("item_id", "rank", "doc_id", "score"))
    return out
