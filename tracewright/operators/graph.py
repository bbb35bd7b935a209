"""Process graphs of runs: nodes, edges, what they show, and metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import containment
from tracewright.operators.phases import by_seq
from tracewright.operators.traversal import cut


VIEW = "str_replace_editor: view"
#: Occurrences of a task: the sorts and groups of a stage take about 600 MB for them at once.
TASK_ROWS = 100_000


def signature(label: str, *maps: str) -> Column:
    """One key for a label and maps that are equal, whatever the order of their entries."""
    # sort_array compares natively, array_sort by a lambda for each comparison; keys of a map are all different.
    entries = [F.sort_array(F.map_entries(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))).alias(m) for m in maps]
    return F.md5(F.to_json(F.struct(label, *entries)))


def argument(frame: DataFrame, name: str) -> Column:
    """An argument as text from a frame's args, a map of text or a VARIANT (an array of whole numbers is "[1,2]")."""
    return F.try_variant_get("args", f"$.{name}", "string") if dict(frame.dtypes)["args"] == "variant" else F.element_at("args", name)


def node_occurrences(actions: DataFrame, key: str = "label") -> DataFrame:
    """actions with node_ord: equal keys of a run are one node, numbered by first occurrence."""
    first = F.min("seq").over(Window.partitionBy("traj", key))
    return actions.withColumn("_first", first).withColumn("node_ord", F.dense_rank().over(Window.partitionBy("traj").orderBy("_first")).cast("long") - 1).drop("_first")


def dealt(occurrences: DataFrame) -> DataFrame:
    """occurrences dealt by run over as many tasks as their number asks for, so that no task grows with the input."""
    least = occurrences.sparkSession.sparkContext.defaultParallelism
    return occurrences.repartition(max(least, -(-occurrences.count() // TASK_ROWS)), "traj")


def in_node_order(occurrences: DataFrame) -> DataFrame:
    """occurrences with seq numbered anew: by step, within a step by node, within a node by time. Metrics and phase
    sequences read a run in this order, and the last action of a step is the last one in it."""
    w = Window.partitionBy("traj").orderBy("step_idx", "node_ord", "seq")
    return occurrences.withColumn("seq", F.row_number().over(w).cast("long") - 1)


def nodes(occurrences: DataFrame) -> DataFrame:
    """A row for each node: the first occurrence's attributes, the last one's value, and all steps in order."""
    return occurrences.groupBy("traj", "node_ord").agg(
        F.min_by("label", "seq").alias("label"),
        F.count("*").alias("n_occ"),
        F.min("step_idx").alias("first_step"),
        F.max("step_idx").alias("last_step"),
        F.max_by("value", "seq").alias("last_value"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "step_idx", "phase"))), lambda x: x["step_idx"]).alias("step_indices"),
    )


def full_nodes(occurrences: DataFrame) -> DataFrame:
    """A row for each node with all that a graph keeps of it: label, args and flags of the first occurrence, has_cd of
    any, lengths of the last thought, what was observed where it was last a step's last action, and its steps and phases
    in order. key is its place and label. occurrences: also args, flags, has_cd, thought, observation, outcome."""
    ends = F.col("seq") == F.max("seq").over(Window.partitionBy("traj", "step_idx"))
    seen = occurrences.withColumn("_end", ends)
    at_end = lambda c: F.max_by(c, F.when(F.col("_end"), F.col("seq")))
    visits = F.sort_array(F.collect_list(F.struct("seq", "step_idx", "phase")))
    out = seen.groupBy("traj", "node_ord").agg(
        F.min_by("label", "seq").alias("label"),
        F.min_by("args", "seq").alias("args"),
        F.min_by("flags", "seq").alias("flags"),
        F.bool_or("has_cd").alias("has_cd"),
        F.max_by(text.thought_length_raw(F.col("thought")), "seq").alias("thought_len_raw"),
        F.max_by(text.thought_length_clean(F.col("thought")), "seq").alias("thought_len_clean"),
        at_end(F.length(F.coalesce("observation", F.lit("")))).cast("long").alias("observation_len"),
        at_end("outcome").alias("observation_outcome"),
        F.count("*").alias("n_occ"),
        F.min("step_idx").alias("first_step"),
        F.max("step_idx").alias("last_step"),
        visits.alias("_v"),
    )
    return out.select("*", F.concat_ws(":", F.col("node_ord").cast("string"), "label").alias("key"), F.transform("_v", lambda v: v["step_idx"]).alias("step_indices"), F.transform("_v", lambda v: v["phase"]).alias("phases")).drop("_v")


def full_edges(occurrences: DataFrame) -> DataFrame:
    """edges() with the lengths of the step's thought on the first edge of a step, 0 on its others."""
    first = occurrences.groupBy("traj", "step_idx").agg(F.min_by("thought", "seq").alias("_t"))
    own = edges(occurrences).join(first, ["traj", "step_idx"], "left")
    on_first = lambda c: F.when(F.col("is_first_in_step"), c).otherwise(F.lit(0)).cast("long")
    return own.withColumn("thought_len_raw", on_first(text.thought_length_raw(F.col("_t")))).withColumn("thought_len_clean", on_first(text.thought_length_clean(F.col("_t")))).drop("_t")


def hier_edges(nodes: DataFrame) -> DataFrame:
    """traj, src, dst, rank: what views hold others. A view of a path lies in the first view of its closest ancestor; a
    line range in its immediate outer ranges of the same file, else in the last whole view of it, else in the first view
    of its closest ancestor. rank orders the children of a node. nodes: label, args (path, view_range "lo-hi" or two whole
    numbers as an array)."""
    v = nodes.where(F.col("label") == VIEW).select("traj", F.col("node_ord").alias("node"), containment.clean_path(argument(nodes, "path")).alias("path"), argument(nodes, "view_range").alias("_r")).where("path <> ''")
    v = cut(v)  # read by each of the joins below
    whole = v.where("_r is null").select("traj", "node", "path")
    bound = lambda k: F.regexp_extract("_r", r"^\[?\s*(-?\d+)\s*[-,]\s*(-?\d+)\s*\]?$", k)
    ranges = v.where(bound(1) != "").select("traj", "path", "node", bound(1).cast("long").alias("lo"), bound(2).cast("long").alias("hi"))
    parents = containment.closest_parents(whole)
    first = whole.groupBy("traj", "path").agg(F.min("node").alias("src"))
    up = whole.select("traj", F.col("path").alias("child"), F.col("node").alias("dst")).join(parents, ["traj", "child"]).join(first.withColumnRenamed("path", "parent"), ["traj", "parent"])
    up = up.select("traj", "src", "dst", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("dst").alias("c")).alias("rank"))
    nested = containment.nested_ranges(ranges)
    inner = nested.select("traj", F.col("o_node").alias("src"), F.col("i_node").alias("dst"), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("i_node").alias("c")).alias("rank"))
    of_file = ranges.groupBy("traj", "path").agg(F.min("node").alias("_f"))
    outer = containment.attached_ranges(ranges, nested, whole).where("parent is not null").join(of_file, ["traj", "path"])
    outer = outer.select("traj", F.col("parent").alias("src"), F.col("node").alias("dst"), F.struct(F.lit(1).alias("a"), F.col("_f").alias("b"), F.col("node").alias("c")).alias("rank"))
    return up.unionByName(inner).unionByName(outer)


def view_graph(hier: DataFrame, edges: DataFrame) -> DataFrame:
    """traj, parent, child, rank of the views' graph, each pair once. Children that an exec edge leads to as well come
    first, by the first such edge; the others by their rank."""
    led = edges.groupBy("traj", "src", "dst").agg(F.min("edge_ord").alias("_e"))
    own = hier.groupBy("traj", "src", "dst").agg(F.min("rank").alias("_k")).join(led, ["traj", "src", "dst"], "left")
    return own.select("traj", F.col("src").alias("parent"), F.col("dst").alias("child"), F.struct(F.col("_e").isNull().alias("a"), F.coalesce("_e", F.lit(0).cast("long")).alias("b"), F.col("_k").alias("c")).alias("rank"))


def build_graph(actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(occurrences, nodes, exec edges, hier edges) of canonical actions: traj, seq, step_idx, label, args, flags, has_cd,
    phase, thought, observation, outcome. Actions of one label with equal args and flags are one node. args and flags are
    maps of text or VARIANTs. The occurrences are written once, as all else reads them, some parts several times, and
    dealt by run: adaptive execution would join tasks by their compressed bytes."""
    same = actions
    for c, t in actions.dtypes:
        if c in ("args", "flags") and t == "variant":  # a VARIANT has the names of an object in order
            same = same.withColumn(f"_{c}", F.create_map(F.lit(""), F.to_json(c)))
    names = [f"_{c}" if f"_{c}" in same.columns else c for c in ("args", "flags")]
    signed = same.withColumn("signature", signature("label", *names)).drop("_args", "_flags")
    occurrences = dealt(cut(node_occurrences(signed, "signature")))
    nodes = full_nodes(occurrences)
    return occurrences, nodes, full_edges(occurrences), hier_edges(nodes)


def step_details(occurrences: DataFrame) -> DataFrame:
    """traj, node_ord, visits: for each node what was thought, done and observed at each of its visits, in order."""
    visit = F.struct("seq", "step_idx", "thought", F.col("label").alias("action"), "observation", "outcome")
    return occurrences.groupBy("traj", "node_ord").agg(F.array_sort(F.collect_list(visit)).alias("visits"))


def edges(occurrences: DataFrame) -> DataFrame:
    """An exec edge between consecutive actions of a run: edge_ord, src, dst, step_idx, is_first_in_step."""
    w = by_seq()
    linked = occurrences.withColumn("src", F.lag("node_ord").over(w)).withColumn("_step", F.lag("step_idx").over(w)).where("src is not null")
    return linked.select("traj", (F.col("seq") - 1).alias("edge_ord"), "src", F.col("node_ord").alias("dst"), "step_idx", (F.col("step_idx") != F.col("_step")).alias("is_first_in_step"))


def exec_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("traj", "src", "dst").distinct()


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, mean out-degree over distinct pairs, share of back edges, and the most frequent node of each run."""
    n = nodes.groupBy("traj").agg(
        F.count("*").alias("node_count"),
        (F.max("last_step") + 1).alias("step_count"),
        F.sum("n_occ").alias("occurrences"),
        F.count_if(F.col("n_occ") > 1).alias("revisited_nodes"),
        F.max_by("label", F.struct("n_occ", -F.col("node_ord"))).alias("most_freq_node"),
        F.max("n_occ").alias("most_freq"),
    )
    at = nodes.select("traj", "node_ord", "first_step")
    src, dst = at.toDF("traj", "src", "src_step"), at.toDF("traj", "dst", "dst_step")
    back = (F.col("src") == F.col("dst")) | (F.col("dst_step") < F.col("src_step"))
    pairs = edges.groupBy("traj", "src", "dst").agg(F.count("*").alias("_m")).join(src, ["traj", "src"]).join(dst, ["traj", "dst"])
    e = pairs.groupBy("traj").agg(F.sum("_m").alias("edge_count"), F.count("*").alias("pair_count"), (F.sum(F.when(back, F.col("_m")).otherwise(0)) / F.sum("_m")).alias("backedge_fraction"))
    out = n.join(e, "traj", "left").na.fill(0, ["edge_count", "pair_count"]).na.fill(0.0, ["backedge_fraction"])
    out = out.withColumn("avg_out_degree", F.col("pair_count") / F.col("node_count")).withColumn("deduplicated", F.greatest(F.col("occurrences") - F.col("node_count"), F.lit(0)))
    return out.withColumn("dedup_pct", F.col("deduplicated") * 100.0 / F.col("occurrences"))


def degrees(edges: DataFrame) -> DataFrame:
    """traj, node_ord, in_degree, out_degree, exec_out (distinct targets), degree (a self-loop counts once)."""
    ends = edges.select("traj", F.col("src").alias("node_ord"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("to"), F.lit(1).alias("d"))
    ends = ends.unionByName(edges.select("traj", F.col("dst").alias("node_ord"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("long").alias("to"), (F.col("src") != F.col("dst")).cast("int").alias("d")))
    return ends.groupBy("traj", "node_ord").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.countDistinct("to").alias("exec_out"), F.sum("d").alias("degree"))


def last_in_step(occurrences: DataFrame) -> DataFrame:
    """The last action of each step, which carries the step's observation."""
    w = Window.partitionBy("traj", "step_idx").orderBy(F.col("seq").desc())
    return occurrences.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collapsed_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges over consecutive steps as one range: traj, src, dst, from_step, to_step, n."""
    steps = edges.select("traj", "src", "dst", "step_idx").distinct()
    w = Window.partitionBy("traj", "src", "dst").orderBy("step_idx")
    island = steps.withColumn("_i", F.col("step_idx") - F.row_number().over(w))
    return island.groupBy("traj", "src", "dst", "_i").agg(F.min("step_idx").alias("from_step"), F.max("step_idx").alias("to_step"), F.count("*").alias("n")).drop("_i")


def busy_edges(edges: DataFrame, least: int = 10) -> DataFrame:
    """Edges within a step from nodes with `least` or more of them, one for each target: how many, first, last step."""
    inner = edges.where(~F.col("is_first_in_step")).withColumn("_n", F.count("*").over(Window.partitionBy("traj", "src"))).where(F.col("_n") >= least)
    return inner.groupBy("traj", "src", "dst").agg(F.count("*").alias("n"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"))


def inner_edges(edges: DataFrame, occurrences: DataFrame) -> DataFrame:
    """edges with intra_step: both ends share some step and the edge is not its step's first."""
    steps = occurrences.groupBy("traj", "node_ord").agg(F.collect_set("step_idx").alias("_s"))
    pairs = exec_pairs(edges.where(~F.col("is_first_in_step")))  # only these can be inner ones
    src, dst = steps.toDF("traj", "src", "_a"), steps.toDF("traj", "dst", "_b")
    shared = pairs.join(src, ["traj", "src"]).join(dst, ["traj", "dst"]).where(F.arrays_overlap("_a", "_b")).select("traj", "src", "dst")
    return edges.join(shared.withColumn("_s", F.lit(True)), ["traj", "src", "dst"], "left").withColumn("intra_step", F.col("_s").isNotNull() & ~F.col("is_first_in_step")).drop("_s")


def ranged_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """Parallel edges over consecutive steps as one range, with equal values in all of the key's columns: from_step,
    to_step, n, and the greatest lengths of thoughts and observations where edges have these."""
    lengths = [c for c in ("thought_len_raw", "thought_len_clean", "observation_len") if c in edges.columns]
    steps = edges.groupBy("traj", *key, "step_idx").agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in lengths])
    island = steps.withColumn("_i", F.col("step_idx") - F.row_number().over(Window.partitionBy("traj", *key).orderBy("step_idx")))
    return island.groupBy("traj", *key, "_i").agg(F.min("step_idx").alias("from_step"), F.max("step_idx").alias("to_step"), F.sum("_n").alias("n"), *[F.max(c).alias(c) for c in lengths]).drop("_i")


def busy_labels(edges: DataFrame, least: int = 10) -> DataFrame:
    """busy_edges with a label that sums the steps up: "3", "3, 5" or "3..9 (4)"."""
    inner = edges.where(~F.col("is_first_in_step")).withColumn("_n", F.count("*").over(Window.partitionBy("traj", "src"))).where(F.col("_n") >= least)
    steps = inner.groupBy("traj", "src", "dst").agg(F.array_sort(F.collect_set("step_idx")).alias("_s"), F.count("*").alias("n"))
    few = F.array_join(F.transform("_s", lambda s: s.cast("string")), ", ")
    many = F.concat(F.array_min("_s").cast("string"), F.lit(".."), F.array_max("_s").cast("string"), F.lit(" ("), F.size("_s").cast("string"), F.lit(")"))
    return steps.select("traj", "src", "dst", "n", F.when(F.size("_s") <= 2, few).otherwise(many).alias("label"))


def mean_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """traj, avg_degree, max_out_degree, max_exec_out_degree: over all edges (a self-loop counts at both its ends), and
    over distinct exec targets. edges: traj, src, dst, type."""
    n = nodes.groupBy("traj").agg(F.count("*").alias("_n"))
    out = edges.groupBy("traj", "src").agg(F.count("*").alias("_o"), F.countDistinct(F.when(F.col("type") == "exec", F.col("dst"))).alias("_x"))
    top = out.groupBy("traj").agg(F.sum("_o").alias("_e"), F.max("_o").alias("max_out_degree"), F.max("_x").alias("max_exec_out_degree"))
    both = n.join(top, "traj", "left").na.fill(0, ["_e", "max_out_degree", "max_exec_out_degree"])
    return both.select("traj", (F.col("_e") * 2 / F.col("_n")).alias("avg_degree"), "max_out_degree", "max_exec_out_degree")


def start_end(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """traj, start_node, end_node: of the earliest (latest) step, a source (sink) of the exec graph first, then by
    the key's name."""
    into, out = pairs.select("traj", F.col("dst").alias("node_ord")).distinct().withColumn("_in", F.lit(1)), pairs.select("traj", F.col("src").alias("node_ord")).distinct().withColumn("_out", F.lit(1))
    n = nodes.join(into, ["traj", "node_ord"], "left").join(out, ["traj", "node_ord"], "left").withColumn("_k", F.concat_ws(":", F.col("node_ord").cast("string"), "label"))
    start = F.min(F.struct("first_step", F.coalesce("_in", F.lit(0)), "_k", "node_ord"))["node_ord"]
    end = F.max(F.struct("last_step", 1 - F.coalesce("_out", F.lit(0)), "_k", "node_ord"))["node_ord"]
    return n.groupBy("traj").agg(start.alias("start_node"), end.alias("end_node"))


def continuations(occurrences: DataFrame, edges: DataFrame, thoughts: DataFrame) -> DataFrame:
    """traj, step_idx, src, dst: steps whose thought holds the step before's whole thought, where the last edge from the
    first node of that step to theirs is an exec edge. thoughts: traj, step_idx, thought; edges: may have a column type
    (exec where it is missing) and holds hier edges after exec ones."""
    first = occurrences.groupBy("traj", "step_idx").agg(F.min_by("node_ord", "seq").alias("dst"))
    w = Window.partitionBy("traj").orderBy("step_idx")
    told = first.join(thoughts, ["traj", "step_idx"], "left").withColumn("src", F.lag("dst").over(w)).withColumn("_before", F.lag("thought").over(w))
    held = told.where("_before <> '' and contains(thought, _before)").select("traj", "step_idx", "src", "dst")
    if "type" in edges.columns:
        last = edges.groupBy("traj", "src", "dst").agg(F.max_by("type", "edge_ord").alias("type"))
        return held.join(last.where("type = 'exec'").drop("type"), ["traj", "src", "dst"], "left_semi")
    return held.join(exec_pairs(edges), ["traj", "src", "dst"], "left_semi")


def localization_repeats(occurrences: DataFrame) -> DataFrame:
    """traj, loc_avg_node_freq (two decimals), repeated_view: how often localization comes to a node, and whether twice to
    one; 0 and false for runs without it."""
    n = F.count_if(F.coalesce(F.col("phase") == "localization", F.lit(False)))
    visits = occurrences.groupBy("traj", "node_ord").agg(F.nullif(n, F.lit(0)).alias("n"))
    return visits.groupBy("traj").agg(F.coalesce(F.bround(F.avg("n"), 2), F.lit(0.0)).alias("loc_avg_node_freq"), F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("repeated_view"))
