"""Statistics over many runs, listings and their filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def means(rows: DataFrame, stats: list[str], by: list[str] = ()) -> DataFrame:
    """The mean of each statistic, nulls left out, over all rows or by group."""
    return rows.groupBy(*by).agg(*[F.avg(s).alias(s) for s in stats])


def spread(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """metric, median, iqr, mean, std (0 of one row) by group: quantiles are exact and interpolated."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    long = rows.select(*by, one.alias("_m")).select(*by, "_m.metric", "_m.x")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*by, "metric").agg(q.alias("_q"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n"))
    return out.select(*by, "metric", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")).alias("std"), "n")


def statuses(runs: DataFrame, reports: DataFrame | None) -> DataFrame:
    """runs with status from reports (arrays resolved_ids, unresolved_ids): resolved wins, then unresolved, then
    unsubmitted; none without a report."""
    if reports is None:
        return runs.withColumn("status", F.lit("none"))
    named = [reports.select(F.explode(c).alias("traj"), F.lit(k).alias("_k")) for c, k in (("resolved_ids", 0), ("unresolved_ids", 1))]
    best = reduce(DataFrame.unionByName, named).groupBy("traj").agg(F.min("_k").alias("_k"))
    status = F.when(F.col("_k") == 0, "resolved").when(F.col("_k") == 1, "unresolved").otherwise("unsubmitted")
    return runs.join(best, "traj", "left").withColumn("status", status).drop("_k")


def overlap_check(runs: DataFrame, report_ids: DataFrame, least: float = 0.05) -> DataFrame:
    """One row (runs, ids, overlap, status, run_samples, id_samples): an empty report is ok; no runs, no overlap or too
    little is an error. The samples are the three first ids that only one side has."""
    a, b = runs.select("traj").distinct(), report_ids.select("traj").distinct()
    counts = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "traj", "full").agg(F.count("_a").alias("runs"), F.count("_b").alias("ids"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"))
    some = lambda x, y, name: x.join(y, "traj", "left_anti").orderBy("traj").limit(3).agg(F.array_sort(F.collect_list("traj")).alias(name))
    status = F.when(F.col("ids") == 0, "ok").when(F.col("runs") == 0, "error: no runs").when(F.col("overlap") == 0, "error: no overlap").when(F.col("overlap") / F.greatest("runs", "ids") < least, "error: little overlap").otherwise("ok")
    sampled = [f.withColumn("_one", F.lit(1)) for f in (counts.withColumn("status", status), some(a, b, "run_samples"), some(b, a, "id_samples"))]
    return sampled[0].join(sampled[1], "_one").join(sampled[2], "_one").drop("_one")


def model_filter(models: list[str], column: str = "model") -> Column:
    """Whether any of the names is part of the model's."""
    return reduce(lambda a, b: a | b, [F.col(column).contains(m) for m in models], F.lit(False))


def run_filter(agents: list[str] | None = None, models: list[str] | None = None) -> Column:
    """Runs of one of the agents (by its whole name) whose model's name holds one of the models; both may be left out."""
    own = F.col("agent").isin(agents) if agents else F.lit(True)
    return own & model_filter(models) if models else own


def instance_file(path: Column, instance: str | None = None) -> Column:
    """Whether a file lies in a folder of its own name (the instance's, if one is given)."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.traj)?\.[^./]*$", 1)
    own = (stem != "") & (F.regexp_extract(path, r"([^/]*)/[^/]*$", 1) == stem)
    return own if instance is None else own & (stem == instance)


def name_search(text: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def first_runs(runs: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n runs over all sources in order, by top-k on each partition."""
    return runs.orderBy(*order).limit(n)


def truthy(column: str) -> Column:
    low = F.lower(F.trim(F.col(column).cast("string")))
    return F.coalesce(low.isin("1", "true", "t", "yes", "y") | (low.try_cast("double") > 0), F.lit(False))


def resolution_is(column: str, value: str) -> Column:
    return F.lower(F.trim(F.col(column))) == value


#: The names of the difficulty classes.
DIFFICULTIES = {"<15 min fix": "under15min", "15 min - 1 hour": "under1h", "1-4 hours": "under4h", ">4 hours": "over4h"}


def difficulty(column: str) -> Column:
    out = F.lit(None).cast("string")
    for text, name in DIFFICULTIES.items():
        out = F.when(F.lower(F.trim(F.col(column))) == text, name).otherwise(out)
    return out


def pattern_groups(runs: DataFrame) -> DataFrame:
    """traj, grp ("status, difficulty"): runs that are resolved or unresolved and of a known difficulty; the others go."""
    status, hard = F.lower(F.trim("status")), F.coalesce(difficulty("difficulty"), F.when(F.col("difficulty").isin(list(DIFFICULTIES.values())), F.col("difficulty")))
    return runs.select("traj", F.when(status.isin("resolved", "unresolved") & hard.isNotNull(), F.concat_ws(", ", status, hard)).alias("grp")).where("grp is not null")


def localization_metrics(actions: DataFrame) -> DataFrame:
    """traj, loc_focus_ratio, loc_num_clusters, loc_dominant_zone from the phases in order (thirds by floors)."""
    w = Window.partitionBy("traj").orderBy("seq")
    whole = Window.partitionBy("traj")
    loc = F.col("phase") == "localization"
    a = actions.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole)).withColumn("_before", F.coalesce(F.lag("phase").over(w) == "localization", F.lit(False)))
    early, middle = F.floor(F.col("_n") / 3), F.floor(2 * F.col("_n") / 3)
    g = a.groupBy("traj").agg(F.count_if(loc).alias("_l"), F.count("*").alias("_n"), F.count_if(loc & ~F.col("_before")).alias("loc_num_clusters"), F.count_if(loc & (F.col("_i") < early)).alias("_e"), F.count_if(loc & (F.col("_i") >= early) & (F.col("_i") < middle)).alias("_m"), F.count_if(loc & (F.col("_i") >= middle)).alias("_t"))
    most = F.greatest("_e", "_m", "_t")
    zone = F.when(F.col("_l") == 0, "none").when(most / F.col("_l") < 0.5, "mixed").when(F.col("_e") == most, "early").when(F.col("_m") == most, "middle").otherwise("late")
    return g.select("traj", F.bround(F.col("_l") / F.col("_n"), 2).alias("loc_focus_ratio"), "loc_num_clusters", zone.alias("loc_dominant_zone"))
