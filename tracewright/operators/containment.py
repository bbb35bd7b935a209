"""Containment of what runs look at: directories and files, line ranges, and footprints of paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.traversal import cut


def clean_path(path: Column) -> Column:
    """Without doubled slashes, single dots and a closing slash, as path parts are compared."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), "/{2,}", "/"), "(?<=.)/(?:\\.)?$", "")


def prefixes(path: str) -> Column:
    """Strict ancestors of a path as structs (prefix, depth): /a/b/c has /a and /a/b, and a/b/c has a and a/b."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    n, root = F.size(parts), F.when(F.col(path).startswith("/"), "/").otherwise("")
    return F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.concat(root, F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("prefix"), k.alias("depth")))


def closest_parents(paths: DataFrame) -> DataFrame:
    """traj, parent, child: the deepest other path of the run that is a strict ancestor. paths: traj, path.

    Each path offers its ancestors, which meet paths by equality, so the work follows the depth, not the pairs."""
    own = paths.select("traj", "path").where("path <> ''").distinct()
    offered = own.select("traj", F.col("path").alias("child"), F.explode(prefixes("path")).alias("p")).select("traj", "child", F.col("p.prefix").alias("path"), F.col("p.depth").alias("depth"))
    return offered.join(own, ["traj", "path"]).groupBy("traj", "child").agg(F.max_by("path", "depth").alias("parent"))


def nested_ranges(ranges: DataFrame) -> DataFrame:
    """traj, path, o_node, o_lo, o_hi, i_node, i_lo, i_hi: each range of a file in its immediate outer ones. ranges: traj,
    path, node, lo, hi. Equal ranges hold each other, so two of them nest both ways and three block one another.

    A file's ranges are swept in order (lo, -hi); see `surrounding`."""
    own = ranges.groupBy("traj", "path", "lo", "hi").agg(F.collect_set("node").alias("_nodes")).withColumn("_n", F.size("_nodes"))
    # A range that stands twice is in none but its twin, and blocks what it lies around.
    swept = own.select("traj", "path", F.when(F.col("_n") == 1, F.col("_nodes")[0]).alias("node"), "lo", "hi").repartition("traj", "path").sortWithinPartitions("traj", "path", "lo", F.desc("hi"))
    kinds = dict(ranges.dtypes)
    schema = f"traj {kinds['traj']}, path {kinds['path']}, o_node {kinds['node']}, o_lo {kinds['lo']}, o_hi {kinds['hi']}, i_node {kinds['node']}, i_lo {kinds['lo']}, i_hi {kinds['hi']}"
    least = swept.mapInArrow(nested_in_files, schema)
    twins = own.where("_n = 2").select("traj", "path", F.explode(F.array(F.struct(F.col("_nodes")[0].alias("o"), F.col("_nodes")[1].alias("i")), F.struct(F.col("_nodes")[1].alias("o"), F.col("_nodes")[0].alias("i")))).alias("_t"), "lo", "hi")
    twins = twins.select("traj", "path", F.col("_t.o").alias("o_node"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("_t.i").alias("i_node"), F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi"))
    return least.unionByName(twins)


def surrounding(his: list[int]) -> Iterator[tuple[int, int]]:
    """(outer, inner) places of ranges in order (lo, -hi), all different, given by their ends: for each range the least
    ones around it.

    Going back from a range, the ones around it are those that end no earlier; of them those count that end before
    every later one. Each is found by the latest place within an interval of ends, in a tree over the ends."""
    ends = sorted(set(his))
    size = 1 << max(0, (len(ends) - 1).bit_length())
    tree = [-1] * (2 * size)

    def latest(a: int, b: int) -> int:
        found, a, b = -1, a + size, b + size
        while a < b:
            if a & 1:
                found = max(found, tree[a])
                a += 1
            if b & 1:
                b -= 1
                found = max(found, tree[b])
            a, b = a >> 1, b >> 1
        return found

    for i, hi in enumerate(his):
        low, high = bisect_left(ends, hi), len(ends)
        while low < high and (o := latest(low, high)) >= 0:
            yield o, i
            high = bisect_left(ends, his[o])
        at = low + size
        while at:  # a later place is a greater one
            tree[at], at = i, at >> 1


def nested_in_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows traj, path, node (null: stands more than once), lo, hi in order, a file's one after the other."""
    key, held, out, types = None, [], [], None

    def told() -> None:
        node, lo, hi = zip(*held, strict=True)
        for o, i in surrounding(list(hi)):
            if node[o] is not None and node[i] is not None:
                out.append((*key, node[o], lo[o], hi[o], node[i], lo[i], hi[i]))

    def batch() -> pa.RecordBatch:
        kinds = [types[k] for k in (0, 1, 2, 3, 4, 2, 3, 4)]
        names = ["traj", "path", "o_node", "o_lo", "o_hi", "i_node", "i_lo", "i_hi"]
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)
        out.clear()
        return done

    for rows in batches:
        types = rows.schema.types
        for traj, path, node, lo, hi in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (traj, path) != key:
                if len(held) > 1:
                    told()
                key, held = (traj, path), []
            held.append((node, lo, hi))
        if len(out) > 100_000:
            yield batch()
    if len(held) > 1:
        told()
    if types:
        yield batch()


def scrolls(ranges: DataFrame) -> DataFrame:
    """traj, scroll: whether some range of a file starts at or before the end of the one sorted just before it."""
    w = Window.partitionBy("traj", "path").orderBy("lo", "hi")
    return ranges.withColumn("_s", F.coalesce(F.col("lo") <= F.lag("hi").over(w), F.lit(False))).groupBy("traj").agg(F.bool_or("_s").alias("scroll"))


def hierarchy_codes(hier: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """traj, node, code: the path of child places from a root down, the first in depth-first order for each node.

    hier: traj, parent, child and, unless children go by name, rank; alone: nodes (traj, node) that may have no edge.
    Nodes that only cycles reach have no code. Goes on until no node gets a lesser code."""
    nodes = hier.select("traj", F.col("parent").alias("node")).union(hier.select("traj", "child"))
    nodes = (nodes if alone is None else nodes.union(alone.select("traj", "node"))).distinct()
    roots = nodes.join(hier.select("traj", F.col("child").alias("node")).distinct(), ["traj", "node"], "left_anti")
    place = Window.partitionBy("traj", "parent").orderBy("rank" if "rank" in hier.columns else "child")
    steps = hier.distinct().withColumn("_k", F.row_number().over(place) - 1).select("traj", "parent", "child", "_k")
    top = Window.partitionBy("traj").orderBy("node")
    level = roots.select("traj", "node", F.array(F.row_number().over(top) - 1).alias("code"))
    level = found = cut(level)
    while not level.isEmpty():
        level = level.withColumnRenamed("node", "parent").join(steps, ["traj", "parent"]).select("traj", F.col("child").alias("node"), F.concat("code", F.array("_k")).alias("code")).groupBy("traj", "node").agg(F.min("code").alias("code"))
        known = found.select("traj", "node", F.col("code").alias("_c"))
        level = cut(level.join(known, ["traj", "node"], "left").where("_c is null or code < _c").drop("_c"))
        found = cut(found.unionByName(level).groupBy("traj", "node").agg(F.min("code").alias("code")))
    return found


def view_depths(codes: DataFrame, hier: DataFrame, visits: DataFrame) -> DataFrame:
    """traj, max_view_depth, avg_view_depth over visits of leaves, max_view_span, avg_view_span over visits by level.

    visits: traj, node, a row for each time that a run looks there; nodes without a code don't count."""
    seen = visits.select("traj", "node").join(codes, ["traj", "node"])
    leaf = seen.join(hier.select("traj", F.col("parent").alias("node")).distinct(), ["traj", "node"], "left_anti")
    deep = leaf.groupBy("traj").agg(F.max(F.size("code")).cast("long").alias("max_view_depth"), F.bround(F.avg(F.size("code")), 2).alias("avg_view_depth"))
    level = seen.groupBy("traj", F.size("code").alias("_l")).agg(F.count("*").alias("n")).groupBy("traj").agg(F.max("n").alias("max_view_span"), F.bround(F.avg("n"), 2).alias("avg_view_span"))
    return level.join(deep, "traj", "left").select("traj", F.coalesce("max_view_depth", F.lit(0)).cast("long").alias("max_view_depth"), F.coalesce("avg_view_depth", F.lit(0.0)).alias("avg_view_depth"), "max_view_span", "avg_view_span")


def zoom_outs(visits: DataFrame) -> DataFrame:
    """traj, zoom_out: whether some next code is a strict prefix of the one before it. visits: traj, seq, code."""
    w = Window.partitionBy("traj").orderBy("seq")
    nxt = F.lead("code").over(w)
    out = (F.size(nxt) < F.size("code")) & (F.slice("code", F.lit(1), F.greatest(F.size(nxt), F.lit(0))) == nxt)
    return visits.withColumn("_z", F.coalesce(out, F.lit(False))).groupBy("traj").agg(F.bool_or("_z").alias("zoom_out"))


def deep_zooms_without_edit(leaves: DataFrame, patched: DataFrame, q: int = 8) -> DataFrame:
    """traj, n: leaf paths that are part of no patched path. leaves: traj, path; patched: traj, path. No path is empty.

    Patched paths are indexed by their q-grams (shorter ones for leaves that are shorter). A leaf one of whose grams no
    patched path has is part of none; the others are looked for only in the paths that hold their rarest gram."""
    own = leaves.select("traj", "path").distinct().withColumn("_q", F.least(F.length("path"), F.lit(q)))
    edited = patched.select("traj", F.col("path").alias("patched")).distinct()
    grams = lambda path: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(path) - F.col("_q") + 1), lambda i: F.substring(path, i, F.col("_q"))))
    index = edited.join(own.select("traj", "_q").distinct(), "traj").where(F.length("patched") >= F.col("_q")).select("traj", "patched", F.explode(grams(F.col("patched"))).alias("gram"))
    common = index.groupBy("traj", "gram").agg(F.count("*").alias("_c"))
    asked = own.select("traj", "path", F.explode(grams(F.col("path"))).alias("gram")).join(common, ["traj", "gram"], "left")
    rarest = asked.groupBy("traj", "path").agg(F.min_by("gram", F.coalesce("_c", F.lit(0))).alias("gram"), F.min(F.coalesce("_c", F.lit(0))).alias("_c")).where("_c > 0")
    found = rarest.join(index, ["traj", "gram"]).where(F.instr("patched", F.col("path")) > 0).select("traj", "path").distinct()
    left = own.join(found, ["traj", "path"], "left_anti")
    return own.select("traj").distinct().join(left.groupBy("traj").agg(F.count("*").alias("n")), "traj", "left").na.fill(0, ["n"])


def footprint(visits: DataFrame) -> DataFrame:
    """traj, path, first_step, last_step, seen, views, edits, rank: one event a step, an edit over a view over seen.

    visits: traj, step_idx, path, activity."""
    rank = F.when(F.col("activity") == "edit", 2).when(F.col("activity") == "view", 1).otherwise(0)
    step = visits.withColumn("_r", rank).groupBy("traj", "path", "step_idx").agg(F.max("_r").alias("_r"))
    out = step.groupBy("traj", "path").agg(F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"), *[F.count_if(F.col("_r") == k).alias(n) for k, n in ((0, "seen"), (1, "views"), (2, "edits"))])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("traj").orderBy(F.desc("edits"), F.desc("views"), "first_step", "path")).cast("long"))


def directory_rollup(footprints: DataFrame) -> DataFrame:
    """traj, prefix, files, views, edits for every ancestor directory."""
    up = footprints.select("traj", "views", "edits", F.explode(prefixes("path")).alias("p"))
    return up.groupBy("traj", F.col("p.prefix").alias("prefix")).agg(F.count("*").alias("files"), F.sum("views").alias("views"), F.sum("edits").alias("edits"))


def attached_ranges(ranges: DataFrame, nested: DataFrame, views: DataFrame) -> DataFrame:
    """traj, path, lo, hi, parent: ranges within no other one, below the last whole view of their file, else below that
    of the deepest directory viewed. ranges and nested as for nested_ranges; views: traj, path, node."""
    whole = views.groupBy("traj", "path").agg(F.max("node").alias("parent"), F.min("node").alias("_first"))
    inner = nested.select("traj", "path", F.col("i_node").alias("node")).distinct()
    outer = ranges.select("traj", "path", "node", "lo", "hi").distinct().join(inner, ["traj", "path", "node"], "left_anti")
    up = outer.select("traj", "path").distinct().select("traj", F.col("path").alias("file"), F.explode(prefixes("path")).alias("p")).select("traj", "file", F.col("p.prefix").alias("path"), F.col("p.depth").alias("depth"))
    above = up.join(whole, ["traj", "path"]).groupBy("traj", F.col("file").alias("path")).agg(F.max_by("_first", "depth").alias("_above"))
    out = outer.join(whole, ["traj", "path"], "left").join(above, ["traj", "path"], "left")
    return out.select("traj", "path", "node", "lo", "hi", F.coalesce("parent", "_above").alias("parent"))
