"""Shortest ways without a job for each edge."""

from pyspark.sql import functions as F

from tracewright.operators import traversal


def test_shortest_paths_take_no_job_for_each_edge(spark, monkeypatch):
    n, cuts, cut = 25, [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: cuts.append(1) or cut(df))
    pairs = spark.range(n).select(F.lit("long").alias("traj"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    pairs = pairs.unionByName(spark.createDataFrame([("short", 1, 2), ("short", 2, 1)], "traj string, src long, dst long"))
    ends = spark.createDataFrame([("long", 0, n), ("short", 2, 2), ("none", 7, 7), ("apart", 1, 2)], "traj string, start_node long, end_node long")
    got = {r.traj: r.shortest for r in traversal.shortest_paths(pairs, ends).collect()}
    assert got == {"long": n, "short": 0, "none": 0, "apart": None}
    assert len(cuts) <= 2
