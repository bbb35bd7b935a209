"""Frequent phase patterns of groups of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.traversal import cut


def sequences(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, traj, seq (array of letters), lens. groups: traj, grp."""
    parts = F.array_sort(F.collect_list(F.struct("run_no", "abbr", "len")))
    return runs.join(groups, "traj").groupBy("grp", "traj").agg(parts.alias("_p")).select("grp", "traj", F.transform("_p", lambda p: p["abbr"]).alias("seq"), F.transform("_p", lambda p: p["len"]).alias("lens"))


def contiguous(seqs: DataFrame, support: float = 0.3, first_len: int = 12) -> DataFrame:
    """grp, pattern, n, support: contiguous slices that enough of a group's runs have.

    Slices of a frequent slice are frequent, so where none of the greatest length counted is frequent, no longer one is;
    until then the lengths from there to its double, `first_len` at first, are counted as well. Each round is written."""
    total = seqs.groupBy("grp").agg(F.count("*").alias("_total"))
    places = seqs.select("grp", "traj", "seq", F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("_i")).where("size(seq) > 0")

    def lengths(least: int, most: int) -> DataFrame:
        slices = F.transform(F.sequence(F.lit(least), F.least(F.size("seq") - F.col("_i") + 1, F.lit(most))), lambda n: F.slice("seq", F.col("_i"), n))
        own = places.where(F.size("seq") - F.col("_i") + 1 >= least).select("grp", "traj", F.explode(slices).alias("pattern")).distinct()
        counted = own.groupBy("grp", "pattern").agg(F.count("*").alias("n"))
        return cut(counted.join(total, "grp").withColumn("support", F.col("n") / F.col("_total")).where(F.col("support") >= support).drop("_total"))

    out = last = lengths(1, first_len)
    while not last.where(F.size("pattern") >= first_len).isEmpty():
        last, first_len = lengths(first_len + 1, 2 * first_len), 2 * first_len
        out = out.unionByName(last)
    return out


def greedy_match(pattern: Column, seq: Column) -> Column:
    """Places in seq of the pattern's first match with gaps; shorter than the pattern where it has none."""
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))
    return F.aggregate(
        seq, start, lambda s, x: F.struct(F.when(F.element_at(F.concat(pattern, F.array(F.lit(""))), s["k"] + 1) == x, s["k"] + 1).otherwise(s["k"]).alias("k"), F.when(F.element_at(F.concat(pattern, F.array(F.lit(""))), s["k"] + 1) == x, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))
    )["at"]


def longest_patterns(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """grp, pattern, pct, lower: of each group the longest patterns, the one of most support with gaps (ties: the
    larger pattern), and for each place the least run length at the first match."""
    longest = found.withColumn("_l", F.max(F.size("pattern")).over(Window.partitionBy("grp"))).where(F.size("pattern") == F.col("_l")).select("grp", "pattern")
    at = seqs.join(F.broadcast(longest), "grp").withColumn("_at", greedy_match(F.col("pattern"), F.col("seq"))).withColumn("_ok", F.size("_at") == F.size("pattern"))
    total = at.groupBy("grp", "pattern").agg(F.bround(F.count_if("_ok") * 100 / F.count("*"), 0).alias("pct"))
    best = total.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("pct"), F.desc("pattern")))).where("_n = 1").drop("_n")
    lens = at.where("_ok").select("grp", "pattern", F.posexplode(F.transform("_at", lambda i: F.element_at("lens", i + 1))).alias("_k", "_v"))
    lower = lens.groupBy("grp", "pattern", "_k").agg(F.min("_v").alias("_v")).groupBy("grp", "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("lower"))
    return best.join(lower, ["grp", "pattern"])


def gapped(seqs: DataFrame, support: float = 0.3) -> DataFrame:
    """grp, pattern, n, support: subsequences, gaps allowed, that enough of a group's runs have, of any length.

    Patterns grow by one letter at a time: for each run that holds a pattern there is a row with what follows its first
    match, and each different letter of that begins a longer one. What isn't frequent grows no further; it ends when
    nothing is left. A group of one run gives its whole sequence (all its subsequences would be as frequent)."""
    sizes = cut(seqs.groupBy("grp").agg(F.count("*").alias("_total")))
    alone = seqs.join(sizes.where("_total = 1"), "grp").where("size(seq) > 0").select("grp", F.col("seq").alias("pattern"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("support"))
    state = seqs.join(sizes.where("_total > 1"), "grp").select("grp", "traj", F.slice("seq", F.lit(1), F.lit(0)).alias("pattern"), F.col("seq").alias("_rest"), "_total")
    out = alone
    while True:
        # array_position finds the first match, so a run's row for a pattern is one.
        grown = state.select("grp", "traj", "pattern", "_rest", "_total", F.explode(F.array_distinct("_rest")).alias("_x"))
        at = F.array_position("_rest", F.col("_x")).cast("int")
        grown = grown.select("grp", "traj", F.concat("pattern", F.array("_x")).alias("pattern"), F.slice("_rest", at + 1, F.size("_rest") - at).alias("_rest"), "_total")
        counts = grown.groupBy("grp", "pattern").agg(F.count("*").alias("n"), (F.count("*") / F.max("_total")).alias("support"))
        frequent = cut(counts.where(F.col("support") >= support))
        if frequent.isEmpty():
            return out
        out = out.unionByName(frequent)
        state = cut(grown.where("size(_rest) > 0").join(frequent.select("grp", "pattern"), ["grp", "pattern"], "left_semi"))


def compressed(pattern: list[str], max_period: int = 12) -> str:
    """A pattern as text with its repeats folded: the most repeats win, then the shortest period."""
    out, i = [], 0
    while i < len(pattern):
        best = (1, 1)
        for period in range(1, min(max_period, (len(pattern) - i) // 2) + 1):
            times = 1
            while pattern[i + times * period : i + (times + 1) * period] == pattern[i : i + period]:
                times += 1
            if times > best[0]:
                best = (times, period)
        times, period = best
        unit = pattern[i : i + period]
        out.append(unit[0] if times == 1 else f"({', '.join(unit)})^{times}")
        i += times * period
    return ", ".join(out)


def with_text(patterns: DataFrame) -> DataFrame:
    """One row for each group, so a plain Python function will do."""
    return patterns.withColumn("text", F.udf(compressed)("pattern"))
