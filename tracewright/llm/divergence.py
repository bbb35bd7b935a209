"""Source divergence audit: how far the sources of a language are from each other, and which terms set each one apart.

Terms of whole texts are counted by language and source; a language keeps the terms that enough of its documents have.
A group's (a source of a language) smoothed share of a term is a whole number of billionths, so all sums are exact.

The distance of two groups is a sum over all kept terms. Kept terms are dealt by a hash into blocks of about `block`
term ids; in a block each group's counts are the leaves of a segment tree. Trees are hash-consed: subtrees with the same
counts in the same order are one node, wherever they stand. Two trees are gone through together from their roots, level
by level, and equal pairs of nodes are priced once, with how often they occur; at the leaves a pair of counts has one
price. Sources are dealt into tiles of about `tile`, and each pair of tiles is a task of its own in each block, so what a
task holds is bounded however many terms and sources a language has.

Defined results: null text, lang and source count as ''; a group without terms has count 0 of each kept term; where no
term is kept all distances are 0 and there are no terms to tell; rows that repeat count each; an empty table gives none.
Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import parts_for, worker_cache, written
from tracewright.llm.terms import folding, term_lists

TABLE = folding(digits=False)
UNIT = 1_000_000_000
SMOOTH = 5
#: Different terms of all groups that a task counts before it hands them on, and bytes of texts split at once.
HELD, BATCH_BYTES = 1_500_000, 8 << 20


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (places), docs: partial counts, several rows for a term of a group."""

    def count(batches):
        worker_cache("divergence")
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def told():
            for (lang, source), (places, held) in groups.items():
                terms = list(places)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([places[t] for t in some], pa.int64()), pa.array([held[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            groups.clear()

        def add(waiting):
            for key, texts in waiting.items():
                places, held = groups.setdefault(key, (Counter(), Counter()))
                places.update(chain.from_iterable(chain.from_iterable(texts)))
                held.update(chain.from_iterable(set().union(*parts) for parts in texts))

        for batch in batches:
            waiting, size = {}, 0
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw = text.as_py()
                waiting.setdefault((lang.as_py(), source.as_py()), []).append(list(term_lists(raw, TABLE)))
                size += len(raw)
                if size >= BATCH_BYTES:
                    add(waiting)
                    waiting, size = {}, 0
            add(waiting)
            if sum(len(p) for p, _ in groups.values()) > HELD:
                yield from told()
        yield from told()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 5) / total) by long division, a thousand at a time, so that 64 bits are enough."""
    rest, out = counts + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(4):
        out, rest = out * 1000 + rest // total, rest % total * 1000
    return 1 + out


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row first stands, and the number of each row's kind."""
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        _, code = np.unique(code, return_inverse=True)
        code = code.astype(np.int64) * (int(c.max(initial=0)) + 1) + c
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    return first, kind


class Forest:
    """Hash-consed segment trees over rows of counts. levels: from the leaves up, each node's two children; below the
    leaves are counts, -1 where there is no term."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        full = 1 << max(0, (width - 1).bit_length())
        padded = np.full((n, full), -1, np.int64)
        padded[:, :width] = rows
        self.counts, nodes = np.unique(padded, return_inverse=True)
        nodes, self.levels = nodes.reshape(n, full), []
        while nodes.shape[1] > 1:
            left, right = nodes[:, ::2].ravel(), nodes[:, 1::2].ravel()
            first, kind = numbered(left, right)
            self.levels.append((left[first], right[first]))
            nodes = kind.reshape(n, -1)
        self.roots = nodes[:, 0]

    def distances(self, a: np.ndarray, b: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """The sum over all terms of what the shares of trees a[k] and b[k] differ by, for each k."""
        pair, u, v, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for left, right in reversed(self.levels):
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            u, v = np.concatenate([left[u], right[u]]), np.concatenate([left[v], right[v]])
            first, kind = numbered(pair, u, v)
            times = np.bincount(kind, weights=times, minlength=len(first)).astype(np.int64)
            pair, u, v = pair[first], u[first], v[first]
        real = self.counts[u] >= 0
        pair, u, v, times = pair[real], u[real], v[real], times[real]
        price = np.abs(shares(self.counts[u], totals[a[pair]]) - shares(self.counts[v], totals[b[pair]])) * times
        out = np.zeros(len(a), np.int64)
        np.add.at(out, pair, price)
        return out


def block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """lang, source, item, value: in one block of term ids the distances between two tiles' groups, one row a pair.
    rows: lang, tile_a, tile_b, tile, source, term, n, total, width; a row without a term for each group."""
    groups, at = np.unique(rows.source.to_numpy(object), return_inverse=True)
    there = rows.term.notna().to_numpy()
    terms, column = np.unique(rows.term[there].to_numpy(object), return_inverse=True)
    # Common terms first: what most groups lack stands together and is shared.
    seen = np.bincount(column, minlength=len(terms))
    place = np.empty(len(terms), np.int64)
    place[np.argsort(-seen, kind="stable")] = np.arange(len(terms))
    counts = np.zeros((len(groups), int(rows.width.iloc[0])), np.int64)
    counts[at[there], place[column]] = rows.n[there]
    totals, tile = np.empty(len(groups), np.int64), np.empty(len(groups), np.int64)
    totals[at], tile[at] = rows.total, rows.tile
    a, b = np.nonzero((tile[:, None] == rows.tile_a.iloc[0]) & (tile[None, :] == rows.tile_b.iloc[0]))
    if rows.tile_a.iloc[0] == rows.tile_b.iloc[0]:
        a, b = a[a < b], b[a < b]
    value, forest = np.zeros(len(a), np.int64), Forest(counts)
    for start in range(0, len(a), 512):  # bounds what a level of pairs can hold
        value[start : start + 512] = forest.distances(a[start : start + 512], b[start : start + 512], totals)
    return pd.DataFrame({"lang": rows.lang.iloc[0], "source": groups[a], "item": groups[b], "value": value})


def audited(docs: DataFrame, *, least_docs: int = 30, top_terms: int = 50, block: int = 4096, tile: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank.

    part "pair": every other source of the language with the distance, the farthest first; part "term": the `top_terms`
    kept terms that the source has more often than the language, by the difference of shares."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    # One shuffle by term: all of a term's groups meet, so its documents are known where its counts are.
    by_term = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = by_term.groupBy("lang", "term").agg(F.sum("docs").alias("_d"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("_s")).where(F.col("_d") >= least_docs)
    kept = written(per_term.select("lang", F.col("term").cast("string").alias("term"), "lang_n", "_s"))
    long = kept.select("lang", "term", "lang_n", F.explode("_s").alias("_s")).select("lang", "term", "lang_n", "_s.source", "_s.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = long.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = written(every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0).select("lang", "source", "v", (F.col("own") + SMOOTH * F.col("v")).alias("total"), (F.col("lang_total") + SMOOTH * F.col("v")).alias("lang_sum")))
    out = pairs(groups, kept, long, block, tile).unionByName(terms(groups, long, top_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")


def pairs(groups: DataFrame, kept: DataFrame, long: DataFrame, block: int, tile: int) -> DataFrame:
    sizes = groups.groupBy("lang").agg(F.count("*").alias("_g"), F.max("v").alias("_v")).agg(F.max("_g"), F.max("_v")).first()
    n_blocks, n_tiles = parts_for(int(sizes[1] or 0), block), parts_for(int(sizes[0] or 0), tile)
    tile_of = F.pmod(F.xxhash64(F.lit(3), "source"), F.lit(n_tiles)).cast("int")
    # A tile takes part in its pairs with all tiles: as the first of a pair with later ones, as the second with earlier.
    meets = F.transform(F.sequence(F.lit(0), F.lit(n_tiles - 1)), lambda t: F.struct(F.least(t, F.col("tile")).alias("tile_a"), F.greatest(t, F.col("tile")).alias("tile_b")))
    block_of = F.pmod(F.xxhash64(F.lit(5), "term"), F.lit(n_blocks)).cast("int")
    widths = kept.groupBy("lang", block_of.alias("block")).agg(F.count("*").alias("width"))
    own = groups.where("v > 0").withColumn("tile", tile_of)
    present = own.select("lang", "source", "tile", "total", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    told = long.withColumn("tile", tile_of).join(own.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", "tile", "total", block_of.alias("block"), "term", "n")
    rows = present.unionByName(told).join(widths, ["lang", "block"]).withColumn("_m", F.explode(meets)).select("lang", "block", "_m.tile_a", "_m.tile_b", "tile", "source", "term", "n", "total", "width")
    priced = rows.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(block_pairs, "lang string, source string, item string, value long")
    summed = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A language without kept terms has distances of 0: its sources meet by language.
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    both = summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(none)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(w))


def terms(groups: DataFrame, long: DataFrame, most: int) -> DataFrame:
    # Decimals keep the products exact; `div` of decimals is a whole number.
    share = lambda n, total: F.expr(f"1 + (cast({UNIT} as decimal(18,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div cast({total} as decimal(20,0))")
    told = long.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share("n", "total") - share("lang_n", "lang_sum")).alias("value")).where("value > 0")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return told.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
