"""All metrics of a run in one row, from its graph, and what is counted over them.

Every part reads the occurrences in node order (graph.in_node_order): by step, within a step by node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import aggregates, containment, graph, patches, phases, traversal

#: The labels whose paths count as patched.
PATCHED = ["str_replace_editor: str_replace", "str_replace_editor: create", "str_replace_editor: insert", "ast_editor: str_replace"]
#: The inefficiencies that are told of, by the metric that shows them.
LOCALIZATION_FLAGS = {"RepeatedView": "repeated_view", "ZoomOut": "zoom_out", "Scroll": "scroll_behavior", "OverlyDeepZoom": "num_deep_zooms_without_edit"}
PATCHING_FLAGS = {"UnresolvedRetry": "abandonment", "EditReversion": "flip_flop", "StrNotFound": "fail_not_found", "NoEffectEdit": "fail_no_change", "AmbiguousTarget": "fail_multiple_occurrences"}


def sequences(occurrences: DataFrame) -> DataFrame:
    """traj, phase_sequence (general ones left out, repeats collapsed), label_sequence, step_labels."""
    o = graph.in_node_order(occurrences)
    w = phases.by_seq()
    label = F.trim(F.replace(F.coalesce("label", F.lit("Unknown")), F.lit("\n"), F.lit(": ")))
    named = o.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("seq", "step_idx", label.alias("label")))).alias("_l"))
    kept = o.where("phase <> '' and phase <> 'general'").withColumn("_new", F.coalesce(F.col("phase") != F.lag("phase").over(w), F.lit(True))).where("_new")
    own = kept.groupBy("traj").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "phase"))), lambda x: x["phase"]).alias("phase_sequence"))
    out = named.join(own, "traj", "left")
    return out.select("traj", F.coalesce("phase_sequence", F.array().cast("array<string>")).alias("phase_sequence"), F.transform("_l", lambda x: x["label"]).alias("label_sequence"), F.transform("_l", lambda x: F.struct(x["step_idx"].alias("step_idx"), x["label"].alias("label"))).alias("step_labels"))


def edits(occurrences: DataFrame) -> DataFrame:
    """traj, seq, step_idx, label, path, old, new, edit_status, failed of each patch, in node order."""
    arg = lambda k: F.coalesce(graph.argument(occurrences, k), F.lit(""))
    p = graph.in_node_order(occurrences).where("phase = 'patch'")
    status = graph.argument(occurrences, "edit_status")
    return p.select("traj", "seq", "step_idx", "label", F.nullif(arg("path"), F.lit("")).alias("path"), arg("old_str").alias("old"), arg("new_str").alias("new"), status.alias("edit_status"), F.coalesce(status.startswith("failure:"), F.lit(False)).alias("failed"))


def view_metrics(occurrences: DataFrame, nodes: DataFrame, edges: DataFrame, hier: DataFrame) -> DataFrame:
    """traj, view depths and spans, scroll_behavior, num_deep_zooms_without_edit, back_and_forth_switch, zoom_out."""
    o = graph.in_node_order(occurrences)
    seen = o.where("phase = 'localization'")
    tree = graph.view_graph(hier, edges)
    views = nodes.where(F.col("label") == graph.VIEW).select("traj", F.col("node_ord").alias("node"), graph.argument(nodes, "path").alias("path"))
    codes = traversal.cut(containment.hierarchy_codes(tree, views))
    visits = seen.select("traj", "seq", F.col("node_ord").alias("node"))
    depths = containment.view_depths(codes, tree, visits)
    bound = lambda k: F.regexp_extract(graph.argument(occurrences, "view_range"), r"^\[?\s*(-?\d+)\s*[-,]\s*(-?\d+)\s*\]?$", k)
    ranges = seen.where(bound(1) != "").select("traj", graph.argument(occurrences, "path").alias("path"), bound(1).cast("long").alias("lo"), bound(2).cast("long").alias("hi")).where("path <> ''")
    scroll = containment.scrolls(ranges).withColumnRenamed("scroll", "scroll_behavior")
    zooms = containment.zoom_outs(visits.join(codes, ["traj", "node"]).select("traj", "seq", "code"))
    leaves = views.join(codes.select("traj", "node"), ["traj", "node"], "left_semi").join(tree.select("traj", F.col("parent").alias("node")).distinct(), ["traj", "node"], "left_anti").where("path <> ''")
    patched = nodes.where(F.col("label").isin(PATCHED)).select("traj", graph.argument(nodes, "path").alias("path")).where("path <> ''")
    deep = containment.deep_zooms_without_edit(leaves, patched).withColumnRenamed("n", "num_deep_zooms_without_edit")
    out = reduce(lambda a, b: a.join(b, "traj", "left"), (depths, scroll, zooms, deep), o.select("traj").distinct())
    # Of three paths of a tree two that share more than the third pair does are as long as each other: a switch can't be.
    return out.withColumn("back_and_forth_switch", F.lit(False)).na.fill(0, ["max_view_depth", "avg_view_depth", "max_view_span", "avg_view_span", "num_deep_zooms_without_edit"]).na.fill(False, ["scroll_behavior", "zoom_out"])


def trajectory_metrics(occurrences: DataFrame, nodes: DataFrame, edges: DataFrame, hier: DataFrame, meta: DataFrame | None = None, *, walks: bool = True, max_frontier: int = traversal.STATES) -> DataFrame:
    """One row for each run, from build_graph()'s frames; meta: traj and columns to put before (resolution, difficulty).

    Counts and graph metrics, loops and longest paths (unless walks is off; 0 for a run without edges, null and
    `truncated` where a run has more than max_frontier states at once),
    localization and view metrics, patch metrics with failure kinds as columns and the recovery pattern as text, "N/A"
    where there is none.
    """
    # Every part reads these; they are written once.
    o, nodes, edges, hier = (traversal.cut(f) for f in (graph.in_node_order(occurrences), nodes, edges, hier))
    pairs, changes = graph.exec_pairs(edges), traversal.cut(edits(o))
    counts = graph.graph_metrics(nodes, edges).select("traj", "node_count", F.col("edge_count").alias("exec_edge_count"), "step_count", "avg_out_degree", "backedge_fraction", F.col("most_freq").alias("most_freq_node_freq"))
    keyed = nodes.groupBy("traj").agg(F.replace(F.max_by("key", F.struct("n_occ", -F.col("node_ord"))), F.lit("\n"), F.lit(" ")).alias("most_freq_node"))
    held = hier.groupBy("traj").agg(F.count("*").alias("hier_edge_count"))
    parts = [keyed, held]
    if walks:
        walked = traversal.walk_metrics(pairs, max_states=max_frontier)
        names = [c for c in walked.columns if c != "traj"]
        walked = walked.withColumn("truncated", F.col("loop_count").isNull() | F.col("longest_path").isNull())
        still = o.select("traj").distinct().join(walked, "traj", "left")
        none = F.col("truncated").isNull()
        parts.append(still.select("traj", *[F.when(none, F.lit(0).cast(t)).otherwise(F.col(c)).alias(c) for c, t in walked.dtypes if c in names], F.coalesce("truncated", F.lit(False)).alias("truncated")))
    parts += [
        aggregates.localization_metrics(o),
        graph.localization_repeats(o),
        view_metrics(o, nodes, edges, hier),
        patches.patch_metrics(changes),
        patches.streaks(changes),
        patches.reversals(changes),
        patches.recovery_patterns(o, changes).select("traj", F.col("pattern").alias("fail_to_success_pattern")),
    ]
    out = reduce(lambda a, b: a.join(b, "traj", "left"), parts, counts)
    zero = ["hier_edge_count", "patch_total", "patch_success", *[f"fail_{t.replace(' ', '_')}" for t in patches.FAIL_TYPES], "fail_streak_count", "fail_streak_max", "fail_streak_avg"]
    out = out.na.fill(0, zero).na.fill(False, ["flip_flop", "repeat_failed_edit", "abandonment"]).na.fill("", ["fail_others"]).na.fill("N/A", ["fail_to_success_pattern"])
    out = out.withColumn("edge_count", F.col("exec_edge_count") + F.col("hier_edge_count"))
    return out if meta is None else meta.join(out, "traj")


def trajectory_stats(nodes: DataFrame, edges: DataFrame, hier: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """traj, graph sizes, how many occurrences the nodes save, out-degrees, loop components, terminal nodes and the
    shortest way between them; sizes: traj, n_lines, n_chars of the raw logs."""
    typed = edges.select("traj", "src", "dst", F.lit("exec").alias("type")).unionByName(hier.select("traj", "src", "dst", F.lit("hier").alias("type")))
    pairs = traversal.cut(graph.exec_pairs(edges))
    counts = graph.graph_metrics(nodes, typed.withColumn("edge_ord", F.lit(0))).select("traj", F.col("node_count").alias("graph_nodes"), F.col("edge_count").alias("graph_edges"), F.col("occurrences").alias("total_action_occurrences"), "deduplicated", "revisited_nodes", "dedup_pct")
    ends = graph.start_end(nodes, pairs)
    parts = [graph.mean_degrees(nodes, typed).drop("avg_degree"), traversal.loop_components(pairs), ends, traversal.shortest_paths(pairs, ends)]
    out = reduce(lambda a, b: a.join(b, "traj", "left"), parts, counts).na.fill(0, ["loop_components", "loop_nodes"])
    return out if sizes is None else out.join(sizes, "traj", "left")


def with_transitions(metrics: DataFrame, flags: DataFrame) -> DataFrame:
    """metrics with the transition flags (0 where a run has none)."""
    names = [c for c in flags.columns if c != "traj"]
    return metrics.join(flags, "traj", "left").na.fill(0, names)


def inefficiencies(metrics: DataFrame, flags: dict[str, str]) -> DataFrame:
    """traj and a boolean for each flag whose metric is a column: true, or a number over 0."""
    kinds = dict(metrics.dtypes)

    def one(column: str) -> Column:
        if column not in kinds:
            return F.lit(False)
        return F.coalesce(F.col(column) if kinds[column] == "boolean" else aggregates.truthy(column), F.lit(False))

    return metrics.select("traj", *[one(c).alias(name) for name, c in flags.items()])


def flag_totals(flags: DataFrame, names: list[str]) -> DataFrame:
    """name, n, pct of each set that isn't empty, and of the runs in any of them ("any")."""
    any_ = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    long = flags.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("own")) for n in names], F.struct(F.lit("any").alias("name"), any_.alias("own")))).alias("f"))
    return long.groupBy(F.col("f.name").alias("name")).agg(F.count_if("f.own").alias("n"), F.bround(F.count_if("f.own") * 100.0 / F.count("*"), 2).alias("pct")).where("n > 0")


def resolution_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """The share of resolved runs, in percent, by group. runs: status and the group's columns."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.round(F.avg((F.col("status") == "resolved").cast("double")) * 100, 1).alias("rate"))


def sorted_listing(runs: DataFrame, order: str = "name") -> DataFrame:
    """A listing by name, or by its steps: "steps" from few, "-steps" from many; runs without steps come last."""
    return runs.orderBy({"name": F.lower("traj"), "steps": F.col("step_count").asc_nulls_last(), "-steps": F.col("step_count").desc_nulls_last()}[order], "traj")


def pattern_matrix(patterns: DataFrame, units: list[str] | None = None) -> DataFrame:
    """status, difficulty, and a column for each unit (an agent with a model) with the group's pattern and its share.
    patterns: unit, status, difficulty, text, pct. Naming the units saves a job."""
    cell = F.concat_ws(" ", "text", F.concat(F.lit("("), F.col("pct").cast("int").cast("string"), F.lit("%)")))
    return patterns.groupBy("status", "difficulty").pivot("unit", units).agg(F.first(cell))


def segments(nodes: DataFrame, edges: DataFrame, *, over: int = 100, least: int = 50, most: int = 150, target: int = 100, shared: int = 1) -> DataFrame:
    """traj, segment, node_ord: runs of more than `over` nodes in pieces of `least` to `most` nodes that share `shared`
    nodes with the next. A piece ends at the plan node nearest to its target size, else at the node of least degree.
    Smaller runs are one piece. nodes: traj, node_ord, label; edges: traj, src, dst.

    Choosing ends is sequential in a run, and takes three numbers for each node."""
    degree = graph.degrees(edges).select("traj", "node_ord", "degree")
    plan = F.coalesce(F.regexp_replace(F.lower("label"), "[_-]", "").rlike("updateplan|todowrite|planmode"), F.lit(False))
    own = nodes.select("traj", "node_ord", plan.alias("is_plan")).join(degree, ["traj", "node_ord"], "left").na.fill(0, ["degree"])
    kind = dict(nodes.dtypes)["traj"]

    def cut_up(pdf):
        import pandas as pd

        v = pdf.sort_values("node_ord", ignore_index=True)
        n, start, piece, rows = len(v), 0, 0, []
        while True:
            if n - start <= (over if piece == 0 else most):
                end = n
            else:
                near = v.iloc[start + least : min(start + most, n - 1) + 1]
                plans = near[near.is_plan]
                pick = plans.assign(far=(plans.index - start - target).__abs__()).sort_values(["far", "node_ord"]) if len(plans) else near.assign(far=(near.index - start - target).__abs__()).sort_values(["degree", "far", "node_ord"])
                end = int(pick.index[0])
            rows += [(v.traj[0], piece, int(k)) for k in v.node_ord[start:end]]
            if end >= n:
                return pd.DataFrame(rows, columns=["traj", "segment", "node_ord"])
            start, piece = end - shared, piece + 1

    return own.groupBy("traj").applyInPandas(cut_up, f"traj {kind}, segment long, node_ord long")


def segment_edges(edges: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges within a segment, and what cut edges lead to as anchors: traj, segment, node_ord, outside."""
    at = lambda c: pieces.select("traj", F.col("node_ord").alias(c), F.col("segment").alias(f"_{c}"))
    both = edges.join(at("src"), ["traj", "src"]).join(at("dst"), ["traj", "dst"])
    inside = both.where("_src = _dst").withColumn("segment", F.col("_src")).drop("_src", "_dst").dropDuplicates(["traj", "segment", "edge_ord"])
    lost = edges.join(inside.select("traj", "edge_ord"), ["traj", "edge_ord"], "left_anti")
    ends = lost.join(at("src"), ["traj", "src"]).select("traj", F.col("_src").alias("segment"), F.col("src").alias("node_ord"), F.col("dst").alias("outside"))
    ends = ends.unionByName(lost.join(at("dst"), ["traj", "dst"]).select("traj", F.col("_dst").alias("segment"), F.col("dst").alias("node_ord"), F.col("src").alias("outside")))
    return inside, ends.distinct()
