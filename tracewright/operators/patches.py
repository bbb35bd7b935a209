"""How edits of runs fare: outcomes, streaks, reversals, what leads from failure to success."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of failure that get a column each.
FAIL_TYPES = ["not found", "no change", "multiple occurrences", "unknown", "invalid code"]


def streaks(patches: DataFrame) -> DataFrame:
    """traj, fail_streak_count, fail_streak_max, fail_streak_avg (two decimals) of runs of failed patches.

    patches: traj, seq, failed."""
    w = Window.partitionBy("traj").orderBy("seq")
    island = patches.withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy("traj", "failed").orderBy("seq")))
    runs = island.where("failed").groupBy("traj", "_i").agg(F.count("*").alias("n"))
    found = runs.groupBy("traj").agg(F.count("*").alias("fail_streak_count"), F.max("n").alias("fail_streak_max"), F.bround(F.avg("n"), 2).alias("fail_streak_avg"))
    return patches.select("traj").distinct().join(found, "traj", "left").na.fill(0, ["fail_streak_count", "fail_streak_max"]).na.fill(0.0, ["fail_streak_avg"])


def patch_metrics(patches: DataFrame) -> DataFrame:
    """traj, patch_total, patch_success, a count for each known kind of failure, and fail_others: the other kinds by
    name with their counts ("disk full:2,locked:1"). patches: traj, seq, edit_status."""
    kind = F.trim(F.regexp_extract("edit_status", "^failure:(.*)$", 1))
    failed = F.coalesce(F.col("edit_status").startswith("failure:"), F.lit(False))
    counts = [F.count_if(F.coalesce(kind == t, F.lit(False))).alias(f"fail_{t.replace(' ', '_')}") for t in FAIL_TYPES]
    totals = patches.groupBy("traj").agg(F.count("*").alias("patch_total"), F.count_if(~failed).alias("patch_success"), *counts)
    rare = patches.where(failed & ~kind.isin(FAIL_TYPES)).groupBy("traj", kind.alias("_k")).agg(F.count("*").alias("_n"))
    named = rare.groupBy("traj").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_k", F.col("_n").cast("string")))), ",").alias("fail_others"))
    return totals.join(named, "traj", "left").na.fill("", ["fail_others"])


def reversals(patches: DataFrame) -> DataFrame:
    """traj, flip_flop, repeat_failed_edit, abandonment. patches: traj, seq, path, old, new, failed, label."""
    w = Window.partitionBy("traj").orderBy("seq")
    before = F.lag(F.struct("path", "old", "new")).over(w)
    swapped = before.isNotNull() & (before["path"] == F.col("path")) & (before["old"] == F.col("new")) & (before["new"] == F.col("old"))
    tried = F.row_number().over(Window.partitionBy("traj", "path", "old", "new").orderBy("seq")) > 1
    marked = patches.withColumn("_flip", F.coalesce(swapped, F.lit(False)) | F.coalesce(F.col("label").contains("undo_edit"), F.lit(False))).withColumn("_again", tried & F.col("failed"))
    path = patches.where("path is not null").groupBy("traj", "path").agg(F.bool_and("failed").alias("_none")).groupBy("traj").agg(F.bool_or("_none").alias("abandonment"))
    return marked.groupBy("traj").agg(F.bool_or("_flip").alias("flip_flop"), F.bool_or("_again").alias("repeat_failed_edit")).join(path, "traj", "left").na.fill(False, ["abandonment"])


def spans(actions: DataFrame, patches: DataFrame) -> DataFrame:
    """traj, seq, recovers, pattern: the phases strictly between the step of each patch and of the one before it. A step
    takes its last action's phase, one without actions is unknown; patch is left out, then repeats are collapsed; spans
    that leave nothing give no row. recovers: the patch succeeds and the one before failed."""
    w = Window.partitionBy("traj").orderBy("seq")
    pairs = patches.withColumn("_failed", F.lag("failed").over(w)).withColumn("_from", F.lag("step_idx").over(w)).where(F.col("step_idx") - F.col("_from") > 1)
    inside = pairs.select("traj", "seq", (F.col("_failed") & ~F.col("failed")).alias("recovers"), F.explode(F.sequence(F.col("_from") + 1, F.col("step_idx") - 1)).alias("step_idx"))
    last = actions.groupBy("traj", "step_idx").agg(F.max_by("phase", "seq").alias("phase"))
    seen = inside.join(last, ["traj", "step_idx"], "left").withColumn("phase", F.coalesce("phase", F.lit("unknown"))).where("phase <> 'patch'")
    v = Window.partitionBy("traj", "seq").orderBy("step_idx")
    seen = seen.withColumn("_keep", F.coalesce(F.col("phase") != F.lag("phase").over(v), F.lit(True))).where("_keep")
    return seen.groupBy("traj", "seq", "recovers").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", "phase"))), lambda x: x["phase"]), ">").alias("pattern"))


def reasoning_spans(actions: DataFrame, patches: DataFrame) -> DataFrame:
    """traj, pattern, n: how often each sequence of phases stands between consecutive patches."""
    return spans(actions, patches).groupBy("traj", "pattern").agg(F.count("*").alias("n"))


def recovery_patterns(actions: DataFrame, patches: DataFrame) -> DataFrame:
    """traj, pattern, n: the most common sequence of phases between a failed patch and the next one that succeeds;
    equal counts go to the first seen. actions and patches: in node order (graph.in_node_order)."""
    counts = spans(actions, patches).where("recovers").groupBy("traj", "pattern").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    return counts.groupBy("traj").agg(F.max_by(F.struct("pattern", "n"), F.struct("n", -F.col("_first"))).alias("_b")).select("traj", "_b.pattern", "_b.n")


def overlap_regions(flags: DataFrame, names: list[str]) -> DataFrame:
    """regions (names joined by "+"), n, pct: disjoint regions of the sets that flags span, as shares of all rows."""
    inside = F.concat_ws("+", *[F.when(F.col(n), F.lit(n)) for n in names])
    total = F.sum("n").over(Window.partitionBy())
    return flags.groupBy(*names).agg(F.count("*").alias("n")).withColumn("pct", F.bround(F.col("n") * 100.0 / total, 2)).select(inside.alias("region"), "n", "pct").where("region <> ''")
