"""Windows over runs of any length: blocked scans.

A run's rows are cut into blocks of consecutive places; each block is summed up, what comes before it follows from the
blocks' sums (one row for each block), and within a block a plain window does the rest. So a run of any length spreads
over tasks, where a window by run alone would put it into one. Results equal those of the plain windows.

actions: traj, seq (a run's places, from 0, gaps allowed) and what each function names. `numbered` gives places to rows
that only have an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import phases
from tracewright.operators.traversal import cut

#: Places in a block.
BLOCK = 1 << 16


def numbered(rows: DataFrame, order: list[str], *, partitions: int | None = None) -> DataFrame:
    """rows with seq, the place in their run by `order` (which must tell a run's rows apart): dealt by ranges, counted in
    each range, and the ranges' counts added up."""
    dealt = rows.repartitionByRange(partitions, "traj", *order) if partitions else rows.repartitionByRange("traj", *order)
    # Written first: which rows a range holds may differ between attempts.
    placed = cut(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("traj", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("traj").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("traj", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("traj", "_range").orderBy(*order)
    out = placed.join(starts, ["traj", "_range"]).withColumn("seq", (F.col("_start") + F.row_number().over(own) - 1).cast("long"))
    return out.drop("_range", "_start")


def blocked(rows: DataFrame, block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col("seq") / block))


def within() -> Window:
    return Window.partitionBy("traj", "_block").orderBy("seq")


def blocks() -> Window:
    return Window.partitionBy("traj").orderBy("_block")


def lagged(rows: DataFrame, columns: list[str], *, name: str = "before", block: int = BLOCK) -> DataFrame:
    """rows with a struct of the columns in the run's row before; null in its first row."""
    own, value = blocked(rows, block), F.struct(*columns)
    last = own.groupBy("traj", "_block").agg(F.max_by(value, "seq").alias("_last"))
    carry = last.select("traj", "_block", F.lag("_last").over(blocks()).alias("_carry"))
    first = F.row_number().over(within()) == 1
    return own.join(carry, ["traj", "_block"]).withColumn(name, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(within()))).drop("_block", "_carry")


def running(rows: DataFrame, value: Column, *, name: str, how: str = "sum", before: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with the sum, least or greatest value of the run's rows up to each (before: up to the one before it). Nulls
    are left out; null where there is nothing yet."""
    total = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    own = blocked(rows, block).withColumn("_v", value)
    sums = own.groupBy("traj", "_block").agg(total("_v").alias("_t"))
    carry = sums.select("traj", "_block", total("_t").over(blocks().rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inner = total("_v").over(within().rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    both = {"sum": F.when(F.col("_carry").isNull(), F.col("_in")).otherwise(F.col("_carry") + F.coalesce("_in", F.lit(0))), "min": F.least("_carry", "_in"), "max": F.greatest("_carry", "_in")}[how]
    return own.join(carry, ["traj", "_block"]).withColumn("_in", inner).withColumn(name, both).drop("_v", "_block", "_carry", "_in")


def resolved(actions: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """phases.resolved() for runs of any length."""
    seen = running(actions, F.col("phase_class") == "patch", name="_patched", how="max", before=True, block=block)
    patched = F.coalesce("_patched", F.lit(False))
    phase = F.when(F.col("phase_class") == "ctx", F.when(patched, "validation").otherwise("localization")).when(F.col("phase_class") == "loc", "localization").otherwise(F.col("phase_class"))
    return seen.withColumn("phase", phase).drop("_patched")


def phase_runs(actions: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """phases.phase_runs() for runs of any length."""
    kept = actions.select("traj", "seq", "phase", phases.letter(F.col("phase")).alias("abbr")).where("abbr is not null")
    told = lagged(kept, ["abbr"], name="_b", block=block)
    marked = running(told, F.coalesce(F.col("abbr") != F.col("_b.abbr"), F.lit(True)).cast("long"), name="run_no", block=block)
    return marked.withColumn("run_no", F.col("run_no") - 1).groupBy("traj", "run_no").agg(F.min("phase").alias("phase"), F.min("abbr").alias("abbr"), F.count("*").alias("len"))


def edges(occurrences: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """graph.edges() for runs of any length."""
    told = lagged(occurrences, ["node_ord", "step_idx"], name="_b", block=block).where("_b is not null")
    return told.select("traj", (F.col("seq") - 1).alias("edge_ord"), F.col("_b.node_ord").alias("src"), F.col("node_ord").alias("dst"), "step_idx", (F.col("step_idx") != F.col("_b.step_idx")).alias("is_first_in_step"))


def node_occurrences(actions: DataFrame, key: str = "label") -> DataFrame:
    """graph.node_occurrences() for runs of any length: a run's different keys are numbered, its rows look them up."""
    first = actions.groupBy("traj", key).agg(F.min("seq").alias("_first"))
    named = numbered(first, ["_first"]).select("traj", key, F.col("seq").alias("node_ord"))
    return actions.join(named, ["traj", key])
