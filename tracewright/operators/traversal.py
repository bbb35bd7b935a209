"""Walks over the exec graphs of runs: elementary cycles, longest simple paths, components, shortest paths.

Runs of at most `small` distinct pairs are looked at whole, one after the other in a task; larger ones go through joins.
Cycles and simple paths are counted by sets of nodes (walks.py); where a component's states pass `max_states` at once
the run is flagged and gets nulls, never a part. Frontiers are written to the checkpoint folder where one is set, which
cuts their lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import walks

#: Distinct pairs of a run that one task takes whole.
SMALL = 100_000
#: States at once of a component: about 100 bytes each.
STATES = 2_000_000

def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again: without its lineage, and without the constraints that a
    checkpoint hands on and that joins multiply, round by round. Local sessions that name no folder get a temporary one."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tracewright-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(pairs: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs of runs of at most `small`, and of the others (None where there are none)."""
    own = pairs.select("traj", "src", "dst").distinct()
    large = own.groupBy("traj").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("traj")
    large = cut(large)
    if large.isEmpty():
        return own, None
    return own.join(large, "traj", "left_anti"), cut(own.join(large, "traj", "left_semi"))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each run, in pieces, from batches in order of traj."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        for end in pc.run_end_encode(batch.column("traj")).run_ends.to_pylist():
            piece = batch.slice(start, end - start)
            if held and not (start == 0 and held[-1].column("traj")[0].equals(piece.column("traj")[0])):
                yield held
                held = []
            held.append(piece)
            start = end
    if held:
        yield held


def by_run(rows: DataFrame, function: Callable[..., list[tuple]], schema: str, *, parts: int | None = None) -> DataFrame:
    """What function makes of the arrays of each run's columns after traj, as rows of traj and the schema's columns. Runs
    follow one another in a task's batches: a group of its own for each costs more than what is done for a small one."""
    dealt = rows.repartition(*([] if parts is None else [parts]), "traj").sortWithinPartitions("traj")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out = [], []

        def told(kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            done = pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["traj", *names])
            keys.clear()
            out.clear()
            return done

        for pieces in whole_runs(batches):
            own = function(*[np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in pieces]) for c in range(1, pieces[0].num_columns)])
            keys += [pieces[0].column(0)[0].as_py()] * len(own)
            out += own
            if len(out) > 10_000:
                yield told(pieces[0].column(0).type)
        if out:
            yield told(pieces[0].column(0).type)

    return dealt.mapInArrow(found, f"traj {dict(rows.dtypes)['traj']}, {schema}")


METRICS = "loop_count long, min_loop long, max_loop long, avg_loop double, longest_path long"


def walk_metrics(pairs: DataFrame, *, max_states: int = STATES, small: int = SMALL, loops: bool = True, paths: bool = True) -> DataFrame:
    """traj, loop_count, min_loop, max_loop, avg_loop, longest_path: null where a run has too many states, or where
    loops or paths aren't asked for."""
    few, many = sized(pairs, small)
    # Few bytes and much work: a number that is asked for is not coalesced.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = by_run(few, lambda src, dst: [walks.of_run(src, dst, max_states, loops=loops, paths=paths)], METRICS, parts=parts)
    return out if many is None else out.unionByName(apart(many, max_states, loops, paths))


def apart(pairs: DataFrame, max_states: int, loops: bool, paths: bool) -> DataFrame:
    """walk_metrics() of large runs: components by joins, each component a group, and paths from one to the next."""
    kind = dict(pairs.dtypes)["traj"]
    own = cut(strong(pairs))
    src, dst = own.toDF("traj", "src", "_a"), own.toDF("traj", "dst", "_b")
    tied = cut(pairs.join(src, ["traj", "src"], "left").join(dst, ["traj", "dst"], "left"))
    inner = tied.where("_a = _b").select("traj", F.col("_a").alias("component"), "src", "dst")
    # Components that no task may take whole have too many states for certain: of so many pairs there are as many states.
    sizes = inner.groupBy("traj", "component").agg(F.count("*").alias("_n"))
    huge = sizes.where(F.col("_n") > SMALL).select("traj").distinct()
    inner = inner.join(huge, "traj", "left_anti")
    out = pairs.select("traj").distinct()
    if loops:

        def counted(part: pd.DataFrame) -> pd.DataFrame:
            try:
                found = walks.cycles(part.src.to_numpy(np.int64), part.dst.to_numpy(np.int64), max_states)
                rows = [(part.traj.iloc[0], k, str(n)) for k, n in enumerate(found) if n]
            except walks.TooMany:
                rows = [(part.traj.iloc[0], None, None)]
            return pd.DataFrame(rows, columns=["traj", "len", "n"]).astype({"len": "Int64"})

        found = inner.groupBy("traj", "component").applyInPandas(counted, f"traj {kind}, len long, n string")
        found = found.unionByName(huge.select("traj", F.lit(None).cast("long").alias("len"), F.lit(None).cast("string").alias("n"))).withColumn("n", F.col("n").try_cast("decimal(38,0)"))
        stats = found.groupBy("traj").agg(F.bool_or(F.col("n").isNull()).alias("_x"), F.sum("n").try_cast("long").alias("loop_count"), F.min("len").alias("min_loop"), F.max("len").alias("max_loop"), (F.sum(F.col("n") * F.col("len")).cast("double") / F.sum("n").cast("double")).alias("avg_loop"))
        out = out.join(stats, "traj", "left")
        known = F.when(F.col("_x").isNull(), F.lit(0))
        value = lambda c: F.coalesce(F.when(~F.col("_x") & F.col("loop_count").isNotNull(), F.col(c)), known.cast(dict(stats.dtypes)[c])).alias(c)
        out = out.select("traj", *[value(c) for c in ("loop_count", "min_loop", "max_loop", "avg_loop")])
    else:
        out = out.select("traj", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in METRICS.split(", ")[:4])])
    if not paths:
        return out.withColumn("longest_path", F.lit(None).cast("long"))
    cross = cut(tied.where("not coalesce(_a = _b, false) and src <> dst").select("traj", "src", "dst"))
    entries = cross.select("traj", F.col("dst").alias("node")).distinct().withColumn("_e", F.lit(True))
    asked = inner.join(entries.withColumnRenamed("node", "src"), ["traj", "src"], "left")

    def within(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part.src.to_numpy(np.int64), part.dst.to_numpy(np.int64)
        try:
            found = walks.longest(a, b, np.unique(a[part._e.notna().to_numpy()]), max_states)
            rows = [(part.traj.iloc[0], e, v, n) for (e, v), n in found.items()]
        except walks.TooMany:
            rows = [(part.traj.iloc[0], None, None, None)]
        return pd.DataFrame(rows, columns=["traj", "entry", "node", "n"]).astype({c: "Int64" for c in ("entry", "node", "n")})

    inside = cut(asked.groupBy("traj", "component").applyInPandas(within, f"traj {kind}, entry long, node long, n long"))
    lost = inside.where("node is null").select("traj").unionByName(huge).distinct()
    ways = inside.where("entry is not null").select("traj", "entry", "node", "n")
    # A path may begin anywhere; then it goes on over a pair between components, and within the one it enters.
    nodes = pairs.select("traj", F.col("src").alias("node")).union(pairs.select("traj", "dst")).distinct()
    level = cut(nodes.withColumn("far", F.lit(0).cast("long")).unionByName(inside.where("entry is null and node is not null").select("traj", "node", F.col("n").alias("far"))).groupBy("traj", "node").agg(F.max("far").alias("far")))
    best = level
    while not level.isEmpty():
        entered = level.withColumnRenamed("node", "src").join(cross, ["traj", "src"]).groupBy("traj", F.col("dst").alias("node")).agg((F.max("far") + 1).alias("far"))
        on = entered.withColumnRenamed("node", "entry").join(ways, ["traj", "entry"]).select("traj", "node", (F.col("far") + F.col("n")).alias("far"))
        new = entered.unionByName(on).groupBy("traj", "node").agg(F.max("far").alias("far"))
        level = cut(new.join(best.withColumnRenamed("far", "_f"), ["traj", "node"], "left").where("_f is null or far > _f").drop("_f"))
        best = cut(best.unionByName(level).groupBy("traj", "node").agg(F.max("far").alias("far")))
    longest = best.groupBy("traj").agg(F.max("far").alias("longest_path")).join(lost, "traj", "left_anti")
    return out.join(longest, "traj", "left")


def cycle_metrics(pairs: DataFrame, max_frontier: int = STATES, small: int = SMALL) -> DataFrame:
    """traj, loop_count, min_loop, max_loop, avg_loop, truncated: a run with too many states has nulls, never a part."""
    out = walk_metrics(pairs, max_states=max_frontier, small=small, paths=False)
    return out.select("traj", "loop_count", "min_loop", "max_loop", "avg_loop", F.col("loop_count").isNull().alias("truncated"))


def longest_path(pairs: DataFrame, max_frontier: int = STATES, small: int = SMALL) -> DataFrame:
    """traj, longest_path (edges of the longest simple path), truncated."""
    out = walk_metrics(pairs, max_states=max_frontier, small=small, loops=False)
    return out.select("traj", "longest_path", F.col("longest_path").isNull().alias("truncated"))


def components(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """traj, node, component: nodes on a cycle or self-loop, with the least node of their component."""

    def whole(src: np.ndarray, dst: np.ndarray) -> list[tuple]:
        alone = set(src[src == dst].tolist())
        return [(v, min(c)) for c in walks.strong(src, dst) if len(c) > 1 or c[0] in alone for v in c]

    few, many = sized(pairs, small)
    out = by_run(few, whole, "node long, component long")
    return out if many is None else out.unionByName(strong(many))


def chained(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with each chain as one pair; the nodes of chains with the ends of theirs (traj, node, left, right); and the
    nodes of rings that nothing else touches, with their least one (traj, node, component).

    A node that one other node leads to and that leads to one is part of a chain. Each such node's pointers, forward and
    back, are doubled until they stand on nodes that are no part of one."""
    into = pairs.groupBy("traj", F.col("dst").alias("node")).agg(F.count("*").alias("_i"), F.min("src").alias("left"))
    out = pairs.groupBy("traj", F.col("src").alias("node")).agg(F.count("*").alias("_o"), F.min("dst").alias("right"))
    links = cut(into.where("_i = 1").join(out.where("_o = 1"), ["traj", "node"]).where("left <> node and right <> node").select("traj", "node", "left", "right", F.col("node").alias("least"), F.lit(False).alias("_l"), F.lit(False).alias("_r")))
    n, covered = links.groupBy("traj").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while covered <= 2 * n:
        at = links.select("traj", F.col("node").alias("_at"), "left", "right", "least", "_l", "_r")
        back, on = at.select("traj", F.col("_at").alias("left"), F.col("left").alias("_left"), F.col("_l").alias("_ll")), at.select("traj", F.col("_at").alias("right"), F.col("right").alias("_right"), F.col("least").alias("_least"), F.col("_r").alias("_rr"))
        links = links.join(back, ["traj", "left"], "left").join(on, ["traj", "right"], "left")
        links = cut(links.select("traj", "node", F.coalesce("_left", "left").alias("left"), F.coalesce("_right", "right").alias("right"), F.least("least", "_least").alias("least"), F.col("_left").isNull().alias("_l"), F.col("_right").isNull().alias("_r")))
        covered *= 2
    rings = links.where("not _r").select("traj", "node", F.col("least").alias("component"))
    ended = links.where("_r").select("traj", "node", "left", "right")
    part = links.select("traj", "node")
    rest = pairs.join(part.withColumnRenamed("node", "src"), ["traj", "src"], "left_anti").join(part.withColumnRenamed("node", "dst"), ["traj", "dst"], "left_anti")
    return cut(rest.unionByName(ended.select("traj", F.col("left").alias("src"), F.col("right").alias("dst"))).distinct()), ended, rings


def trimmed(pairs: DataFrame) -> DataFrame:
    """The pairs without nodes that nothing leads to, or that lead nowhere."""
    into, out = pairs.select("traj", F.col("dst").alias("src")).distinct(), pairs.select("traj", F.col("src").alias("dst")).distinct()
    return cut(pairs.join(into, ["traj", "src"], "left_semi").join(out, ["traj", "dst"], "left_semi"))


def strong(pairs: DataFrame) -> DataFrame:
    """components() by joins: chains become one pair and loose ends go, as long as that takes any off; then in each part
    its least node's reach forward meets its reach back, and what lies in both, in one or in none are parts anew."""
    left, chains, found = cut(pairs.select("traj", "src", "dst").distinct()), [], []
    n = left.count()
    while n:
        left, links, rings = chained(left)
        chains.append(links)
        found.append(rings)
        left = trimmed(left)
        before, n = n, left.count()
        if n == before:
            break
    part = F.lit("")
    nodes = cut(left.select("traj", F.col("src").alias("node")).union(left.select("traj", "dst")).distinct().withColumn("part", part))
    while n:
        pivots = nodes.groupBy("traj", "part").agg(F.min("node").alias("node"))
        tied = left.join(nodes.toDF("traj", "src", "part"), ["traj", "src"]).join(nodes.toDF("traj", "dst", "_p"), ["traj", "dst"]).where("part = _p").select("traj", "src", "dst")
        tied = cut(tied)
        ahead, behind = reached(pivots, tied), reached(pivots, tied.select("traj", F.col("dst").alias("src"), F.col("src").alias("dst")))
        told = nodes.join(ahead.withColumn("_f", F.lit(1)), ["traj", "node"], "left").join(behind.withColumn("_b", F.lit(1)), ["traj", "node"], "left").join(pivots.withColumnRenamed("node", "_pivot"), ["traj", "part"])
        told = cut(told)
        alone = left.where("src = dst").select("traj", F.col("src").alias("node"))
        both = told.where("_f = 1 and _b = 1").select("traj", "node", F.col("_pivot").alias("component"))
        sizes = both.groupBy("traj", "component").agg((F.count("*") > 1).alias("_more"))
        found.append(both.join(sizes, ["traj", "component"]).join(alone.withColumn("_loop", F.lit(True)), ["traj", "node"], "left").where("_more or _loop").select("traj", "node", "component"))
        # A part's name: the path of choices that led to it.
        nodes = cut(told.where("_f is null or _b is null").select("traj", "node", F.concat("part", F.when(F.col("_f") == 1, "f").when(F.col("_b") == 1, "b").otherwise("n"), F.col("_pivot").cast("string")).alias("part")))
        left = cut(left.join(nodes.select("traj", F.col("node").alias("src")), ["traj", "src"], "left_semi").join(nodes.select("traj", F.col("node").alias("dst")), ["traj", "dst"], "left_semi"))
        n = left.count()
    out = pairs.select("traj", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    for part_ in found:
        out = out.unionByName(part_)
    out = cut(out)
    # A chain's nodes lie on a cycle if its ends are of one component; the last ones taken off come first.
    for links in reversed(chains):
        a, b = out.toDF("traj", "left", "_a"), out.toDF("traj", "right", "_b")
        out = cut(out.unionByName(links.join(a, ["traj", "left"]).join(b, ["traj", "right"]).where("_a = _b").select("traj", "node", F.col("_a").alias("component"))))
    least = out.groupBy("traj", "component").agg(F.min("node").alias("_least"))
    return out.join(least, ["traj", "component"]).select("traj", "node", F.col("_least").alias("component"))


def reached(starts: DataFrame, step: DataFrame) -> DataFrame:
    """traj, node: what the starts (traj, node) lead to, and they themselves."""
    seen = level = cut(starts.select("traj", "node"))
    rounds = 0
    while not level.isEmpty():
        onward = level.withColumnRenamed("node", "src").join(step, ["traj", "src"]).select("traj", F.col("dst").alias("node")).distinct()
        level = cut(onward.join(seen, ["traj", "node"], "left_anti"))
        rounds += 1
        seen = seen.unionByName(level) if rounds % 8 else cut(seen.unionByName(level))
    return seen


def loop_components(pairs: DataFrame) -> DataFrame:
    """traj, loop_components, loop_nodes: strongly connected components of two or more nodes, or with a self-loop."""
    stats = components(pairs).groupBy("traj").agg(F.countDistinct("component").alias("loop_components"), F.count("*").alias("loop_nodes"))
    return pairs.select("traj").distinct().join(stats, "traj", "left").na.fill(0)


def condensed_path(pairs: DataFrame) -> DataFrame:
    """traj, condensed_path: edges of the longest path once each component is one node. A node's distance grows with
    each round that some path reaches it in, so there are as many rounds as the longest path has edges."""
    own = cut(components(pairs))
    src, dst = own.toDF("traj", "src", "_a"), own.toDF("traj", "dst", "_b")
    flat = pairs.select("traj", "src", "dst").join(src, ["traj", "src"], "left").join(dst, ["traj", "dst"], "left")
    step = cut(flat.select("traj", F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst")).where("src <> dst").distinct())
    level, length = cut(step.select("traj", F.col("src").alias("node")).distinct()), 0
    found = pairs.select("traj").distinct().withColumn("condensed_path", F.lit(0).cast("long"))
    while not level.isEmpty():
        length += 1
        level = cut(level.withColumnRenamed("node", "src").join(step, ["traj", "src"]).select("traj", F.col("dst").alias("node")).distinct())
        found = found.unionByName(level.select("traj", F.lit(length).cast("long").alias("condensed_path")).distinct())
    return found.groupBy("traj").agg(F.max("condensed_path").alias("condensed_path"))


def shortest_paths(pairs: DataFrame, ends: DataFrame, small: int = SMALL) -> DataFrame:
    """traj, shortest: edges from start_node to end_node, null where there is no way. ends: traj, start_node, end_node."""
    few, many = sized(pairs, small)
    own = large = ends.select("traj", "start_node", "end_node")
    if many is not None:
        runs = many.select("traj").distinct()
        own, large = own.join(runs, "traj", "left_anti"), own.join(runs, "traj", "left_semi")
    # The ends go along as a row of their own: (start, end, true). A run without pairs has just this one.
    rows = own.select("traj", F.col("start_node").alias("src"), F.col("end_node").alias("dst"), F.lit(True).alias("ends")).unionByName(few.withColumn("ends", F.lit(False)))

    def whole(src: np.ndarray, dst: np.ndarray, ends: np.ndarray) -> list[tuple]:
        asked = np.flatnonzero(ends)
        return [(walks.distance(src[~ends].tolist(), dst[~ends].tolist(), int(src[k]), int(dst[k])),) for k in asked.tolist()]

    out = by_run(rows, whole, "shortest long")
    return out if many is None else out.unionByName(shortest_by_joins(many, large))


def shortest_by_joins(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """shortest_paths() of large runs: a round of joins for each edge of the longest way. Sorted joins, as the frontiers
    of all rounds would go through the driver if they were sent to each task."""
    step = pairs.select("traj", F.col("src").alias("node"), "dst")
    level = cut(ends.select("traj", F.col("start_node").alias("node"), F.lit(0).cast("long").alias("far")))
    seen, far = level, 0
    while not level.isEmpty():
        far += 1
        onward = level.hint("merge").join(step, ["traj", "node"]).select("traj", F.col("dst").alias("node")).distinct()
        level = cut(onward.join(seen.select("traj", "node").hint("merge"), ["traj", "node"], "left_anti").withColumn("far", F.lit(far).cast("long")))
        seen = cut(seen.unionByName(level))
    return ends.join(seen.withColumnRenamed("node", "end_node"), ["traj", "end_node"], "left").select("traj", F.col("far").alias("shortest"))
