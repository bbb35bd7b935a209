"""Phases of actions, their runs, flows, ends and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The letter of each phase that counts in sequences.
LETTERS = {"localization": "L", "patch": "P", "validation": "V", "plan": "N"}


def by_seq() -> Window:
    return Window.partitionBy("traj").orderBy("seq")


def resolved(actions: DataFrame) -> DataFrame:
    """Add phase: what depends on history is validation once the run has patched, else localization."""
    before = by_seq().rowsBetween(Window.unboundedPreceding, -1)
    patched = F.coalesce(F.max(F.col("phase_class") == "patch").over(before), F.lit(False))
    phase = F.when(F.col("phase_class") == "ctx", F.when(patched, "validation").otherwise("localization")).when(F.col("phase_class") == "loc", "localization").otherwise(F.col("phase_class"))
    return actions.withColumn("phase", phase)


def letter(phase: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, x in LETTERS.items():
        out = F.when(phase == name, x).otherwise(out)
    return out


def phase_runs(actions: DataFrame) -> DataFrame:
    """traj, run_no, phase, abbr, len: runs of equal phases; general and unknown ones are left out before."""
    kept = actions.withColumn("abbr", letter(F.col("phase"))).where("abbr is not null")
    new = F.coalesce(F.col("abbr") != F.lag("abbr").over(by_seq()), F.lit(True))
    marked = kept.withColumn("run_no", F.sum(new.cast("long")).over(by_seq()) - 1)
    return marked.groupBy("traj", "run_no").agg(F.first("phase").alias("phase"), F.first("abbr").alias("abbr"), F.count("*").alias("len"))


def phase_strings(runs: DataFrame) -> DataFrame:
    """traj, runs ("L_3 P_1 ..."), letters (every action's letter)."""
    ordered = F.array_sort(F.collect_list(F.struct("run_no", "abbr", "len")))
    grouped = runs.groupBy("traj").agg(ordered.alias("_r"))
    return grouped.select("traj", F.array_join(F.transform("_r", lambda r: F.concat_ws("_", r["abbr"], r["len"].cast("string"))), " ").alias("runs"), F.array_join(F.transform("_r", lambda r: F.repeat(r["abbr"], r["len"].cast("int"))), "").alias("letters"))


def phase_flow(runs: DataFrame, status: DataFrame, limit: int = 10) -> DataFrame:
    """status, t, src, dst, n: how often the t-th transition of a run goes so; each sequence ends in T."""
    w = Window.partitionBy("traj").orderBy("run_no")
    steps = runs.withColumn("dst", F.coalesce(F.lead("abbr").over(w), F.lit("T"))).where(F.col("run_no") < limit)
    return steps.join(status, "traj").groupBy("status", F.col("run_no").alias("t"), F.col("abbr").alias("src"), "dst").agg(F.count("*").alias("n"))


def flow_shares(flow: DataFrame, least: float = 0.01) -> DataFrame:
    """Links whose share of their column is at least `least`."""
    column = Window.partitionBy("status", "t")
    return flow.withColumn("share", F.col("n") / F.sum("n").over(column)).where(F.col("share") >= least)


def flow_volumes(flow: DataFrame) -> DataFrame:
    """status, t, node, n: a link adds to both its ends, so inner nodes count twice."""
    ends = flow.select("status", "t", F.col("src").alias("node"), "n").unionByName(flow.select("status", (F.col("t") + 1).alias("t"), F.col("dst").alias("node"), "n"))
    return ends.groupBy("status", "t", "node").agg(F.sum("n").alias("n"))


def state_flow(actions: DataFrame, phases: list[str], max_steps: int, least: int) -> DataFrame:
    """step, state, n, next, n_next: states of runs by place after filtering and collapsing, with transitions."""
    kept = actions.where(F.col("phase").isin(phases))
    new = F.coalesce(F.col("phase") != F.lag("phase").over(by_seq()), F.lit(True))
    states = kept.withColumn("_new", new).where("_new").withColumn("step", F.row_number().over(by_seq()).cast("long") - 1).withColumn("next", F.lead("phase").over(by_seq())).where(F.col("step") < max_steps)
    out = states.groupBy("step", F.col("phase").alias("state"), "next").agg(F.count("*").alias("n_next"))
    return out.withColumn("n", F.sum("n_next").over(Window.partitionBy("step", "state"))).where((F.col("n_next") >= least) & (F.col("step") < max_steps))


def end_phases(actions: DataFrame, status: DataFrame) -> DataFrame:
    """which (first, last), phase, resolved, unresolved: counts of the runs' outer phases.

    General ones are skipped; a first that is plan counts as none, a last that is plan is skipped.
    """
    own = actions.where("phase <> 'general'")
    ends = own.groupBy("traj").agg(F.min_by("phase", "seq").alias("first"), F.max_by("phase", F.when(F.col("phase") != "plan", F.col("seq"))).alias("last"))
    ends = ends.withColumn("first", F.when(F.col("first") != "plan", F.col("first")))
    long = ends.select("traj", F.explode(F.map_from_arrays(F.array(F.lit("first"), F.lit("last")), F.array("first", "last"))).alias("which", "phase")).where("phase is not null")
    return long.join(status, "traj").groupBy("which", "phase").agg(F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))


def transition_flags(runs: DataFrame) -> DataFrame:
    """traj, LV, PL, VL, VP: whether a run ever goes so."""
    w = Window.partitionBy("traj").orderBy("run_no")
    pairs = runs.withColumn("pair", F.concat("abbr", F.lead("abbr").over(w)))
    return pairs.groupBy("traj").agg(*[F.max(F.when(F.col("pair") == p, 1).otherwise(0)).cast("long").alias(p) for p in ("LV", "PL", "VL", "VP")])


def step_phases(actions: DataFrame) -> DataFrame:
    """traj, step_idx, phase: a step's first class that is not general, then history over steps."""
    first = actions.groupBy("traj", "step_idx").agg(F.coalesce(F.min_by("phase_class", F.when(F.col("phase_class") != "general", F.col("seq"))), F.lit("general")).alias("phase_class"))
    return resolved(first.withColumn("seq", F.col("step_idx"))).drop("seq", "phase_class")
