"""Graphs as files, filters by agent, model and instance, groups of runs, samples of ids that don't meet."""

from pyspark.sql import functions as F

from tracewright.operators import aggregates, graph
from tracewright.sources import logs, views

SF = "/root/testdata/sf0.001"


def test_graphs_come_back(spark, tmp_path):
    _, n, e, h = graph.build_graph(views.rich_actions(spark, SF))
    meta = n.select("traj").distinct().selectExpr("traj", "if(traj % 2 = 0, 'A', 'B') agent", "'m-1' model", "'resolved' status", "'under1h' difficulty")
    logs.write_graphs(n, e, h, meta, f"{tmp_path}/g")
    with open(f"{tmp_path}/g/bad.json", "w") as f:
        f.write("{nope")
    back = logs.read_graphs(spark, f"{tmp_path}/g")
    assert {(r.agent, r.model) for r in back.select("agent", "model").distinct().collect()} == {("A", "m-1"), ("B", "m-1")}
    counts = {r.t: (r.n, r.x, r.h) for r in back.select(F.col("graph.instance_name").alias("t"), F.size("nodes").alias("n"), F.size(F.filter("edges", lambda x: x["type"] == "exec")).alias("x"), F.size(F.filter("edges", lambda x: x["type"] == "hier")).alias("h")).collect()}
    sizes = lambda f: {str(r.traj): r["count"] for r in f.groupBy("traj").count().collect()}
    nodes, edges, hier = sizes(n), sizes(e), sizes(h)
    assert counts == {t: (k, edges.get(t, 0), hier.get(t, 0)) for t, k in nodes.items()}
    first = back.select(F.explode("nodes").alias("n"), "graph.debug_difficulty").where("n.node_ord = 0").first()
    assert first.n.id.startswith("0:") and len(first.n.phases) == len(first.n.step_indices) and first.debug_difficulty == "under1h"


def test_filters(spark):
    f = spark.createDataFrame([("SA", "big-v3", "/x/a/a.traj"), ("OH", "small-v2", "/x/b/c.traj"), ("SA", "small-v3", "/x/i/i.traj.json")], "agent string, model string, path string")
    assert f.where(aggregates.run_filter(["SA"], ["big", "v2"])).count() == 1 and f.where(aggregates.run_filter(None, ["v3"])).count() == 2 and f.where(aggregates.run_filter()).count() == 3
    assert [r.path for r in f.where(aggregates.instance_file(F.col("path"))).collect()] == ["/x/a/a.traj", "/x/i/i.traj.json"]
    assert [r.path for r in f.where(aggregates.instance_file(F.col("path"), "i")).collect()] == ["/x/i/i.traj.json"]


def test_groups_and_samples(spark):
    runs = spark.createDataFrame([("a", "Resolved ", "15 min - 1 hour"), ("b", "unresolved", "over4h"), ("c", "unsubmitted", "over4h"), ("d", "resolved", "unknown")], "traj string, status string, difficulty string")
    assert {r.traj: r.grp for r in aggregates.pattern_groups(runs).collect()} == {"a": "resolved, under1h", "b": "unresolved, over4h"}
    r = aggregates.overlap_check(runs, spark.createDataFrame([(f"z{k}",) for k in range(5)], "traj string")).first()
    assert (r.status, r.run_samples, r.id_samples) == ("error: no overlap", ["a", "b", "c"], ["z0", "z1", "z2"])
