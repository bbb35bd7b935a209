"""Actions of runs are dealt over as many tasks as their number asks for, and written once for a graph."""

from pyspark.sql import functions as F

from tracewright.operators import graph
from tracewright.plans import registry
from tracewright.sources import views

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 50, raising=False)
    actions = views.event_actions(spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert actions.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 50))
    assert actions.groupBy("traj").agg((F.max("seq") + 1 == F.count("*")).alias("ok")).where("not ok").isEmpty()


def test_a_graph_reads_its_occurrences_from_one_copy(spark):
    o, n, e, h = registry.built_of(spark, SF)
    assert all("events.parquet" not in f and "tracewright-cut" in f for frame in (o, n, e) for f in frame.inputFiles())


def test_a_graph_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 50, raising=False)
    o = registry.built_of(spark, SF)[0]
    assert o.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-o.count() // 50))
    assert o.groupBy("traj").agg(F.max("seq").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").isEmpty()
