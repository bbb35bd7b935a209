"""Graph, patch, containment and streaming operators on small fixtures, and registered queries against DuckDB."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import aggregates, containment, graph, patches, patterns, phases, traversal
from tracewright.plans import registry
from tracewright.streaming import sessions

SF = "/root/testdata/sf0.001"


def actions(spark, labels, traj="t"):
    return spark.createDataFrame([(traj, i, i, x, "loc", float(i)) for i, x in enumerate(labels)], "traj string, seq long, step_idx long, label string, phase string, value double")


def test_dedupe(spark):
    o = graph.node_occurrences(actions(spark, "ABAAC"))
    n, e = graph.nodes(o), graph.edges(o)
    m = graph.graph_metrics(n, e).first()
    assert (m.node_count, m.edge_count, m.pair_count, m.most_freq_node) == (3, 4, 4, "A")
    assert m.avg_out_degree == pytest.approx(4 / 3) and m.backedge_fraction == pytest.approx(0.5)


def pairs(spark, edges):
    return spark.createDataFrame([("t", a, b) for a, b in edges], "traj string, src long, dst long")


def test_cycles_and_paths(spark):
    p = pairs(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)])
    c = traversal.cycle_metrics(p).first()
    assert (c.loop_count, c.min_loop, c.max_loop, c.avg_loop, c.truncated) == (3, 1, 3, 2.0, False)
    assert traversal.longest_path(p).first().longest_path == 2
    assert tuple(traversal.loop_components(p).first())[1:] == (1, 3)
    full = pairs(spark, [(a, b) for a in range(5) for b in range(5)])
    assert traversal.cycle_metrics(full).first().loop_count == 89
    over = traversal.cycle_metrics(full, max_frontier=10).first()
    assert over.truncated and over.loop_count is None


def test_ranges(spark):
    def nested(*ranges):
        r = spark.createDataFrame([("t", "/a", k, lo, hi) for k, (lo, hi) in enumerate(ranges)], "traj string, path string, node long, lo long, hi long")
        return sorted(((x.o_lo, x.o_hi), (x.i_lo, x.i_hi)) for x in containment.nested_ranges(r).collect())

    assert nested((1, 100), (10, 50), (20, 30), (60, 70)) == [((1, 100), (10, 50)), ((1, 100), (60, 70)), ((10, 50), (20, 30))]
    assert nested((1, 5), (1, 5)) == [((1, 5), (1, 5))] * 2 and nested((1, 5), (1, 5), (1, 5)) == []
    s = lambda *r: containment.scrolls(spark.createDataFrame([("t", "/a", lo, hi) for lo, hi in r], "traj string, path string, lo long, hi long")).first().scroll
    assert s((1, 10), (10, 20)) is True and s((1, 10), (11, 20)) is False


def test_attached_ranges(spark):
    r = spark.createDataFrame([("t", "/a/b.py", 1, 1, 9), ("t", "/a/b.py", 2, 2, 3), ("t", "/a/c.py", 3, 5, 6), ("t", "/z.py", 4, 1, 2)], "traj string, path string, node long, lo long, hi long")
    views = spark.createDataFrame([("t", "/a", 0), ("t", "/a/b.py", 5), ("t", "/a/b.py", 7)], "traj string, path string, node long")
    got = containment.attached_ranges(r, containment.nested_ranges(r), views).collect()
    assert {(x.path, x.lo, x.parent) for x in got} == {("/a/b.py", 1, 7), ("/a/c.py", 5, 0), ("/z.py", 1, None)}


def test_tree(spark):
    p = spark.createDataFrame([("t", x) for x in ("/a", "/a/b/c.py", "/a/b/d/e.py", "/a/b")], "traj string, path string")
    assert {(r.child, r.parent) for r in containment.closest_parents(p).collect()} == {("/a/b", "/a"), ("/a/b/c.py", "/a/b"), ("/a/b/d/e.py", "/a/b")}
    codes = {r.node: r.code for r in containment.hierarchy_codes(containment.closest_parents(p)).collect()}
    assert codes == {"/a": [0], "/a/b": [0, 0], "/a/b/c.py": [0, 0, 0], "/a/b/d/e.py": [0, 0, 1]}
    v = spark.createDataFrame([("t", 0, [0, 0, 1]), ("t", 1, [0, 0]), ("u", 0, [0]), ("u", 1, [0, 1])], "traj string, seq long, code array<int>")
    assert {r.traj: r.zoom_out for r in containment.zoom_outs(v).collect()} == {"t": True, "u": False}


def test_streaks(spark):
    p = spark.createDataFrame([("t", i, x == "F") for i, x in enumerate("FFSFSF")], "traj string, seq long, failed boolean")
    assert tuple(patches.streaks(p).first())[1:] == (3, 2, 1.33)


def test_zones_and_runs(spark):
    a = spark.createDataFrame([("t", i, p, p) for i, p in enumerate(["localization", "general", "localization", "patch", "validation", "validation"])], "traj string, seq long, phase string, phase_class string")
    assert phases.phase_strings(phases.phase_runs(a)).first().runs == "L_2 P_1 V_2"
    assert tuple(aggregates.localization_metrics(a).first())[1:] == (0.33, 2, "early")


def test_spread(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)], "g string, x double")
    got = {r.g: (r.median, r.iqr, r["std"]) for r in aggregates.spread(f, ["x"], ["g"]).collect()}
    assert got["a"] == (1.0, 0.0, 0.0) and got["b"][:2] == (3.0, 3.5)


def test_reports(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "traj string")
    report = spark.createDataFrame([(["a"], ["a", "b"])], "resolved_ids array<string>, unresolved_ids array<string>")
    assert {r.traj: r.status for r in aggregates.statuses(runs, report).collect()} == {"a": "resolved", "b": "unresolved", "c": "unsubmitted"}
    assert aggregates.overlap_check(runs, runs.where("traj = 'z'")).first().status == "ok"
    assert aggregates.overlap_check(runs, spark.createDataFrame([("z",)], "traj string")).first().status == "error: no overlap"


def test_patterns(spark):
    assert patterns.compressed(list("LPLPLPV")) == "(L, P)^3, V"
    seqs = spark.createDataFrame([("g", "a", list("LPV"), [3, 1, 2]), ("g", "b", list("LVPV"), [1, 5, 4, 6])], "grp string, traj string, seq array<string>, lens array<long>")
    r = patterns.longest_patterns(seqs, patterns.contiguous(seqs, 0.6)).first()
    assert (r.pattern, r.pct, r.lower) == (["P", "V"], 100.0, [1, 2])
    assert {tuple(x.pattern) for x in patterns.gapped(seqs, 0.9).collect()} >= {("L", "P", "V")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", 0, "view", "ctx"), ("s", 1, "edit", "patch"), ("s", 2, "view", "ctx"), ("u", 0, "a", "loc")]
    spark.createDataFrame([(a, b, None, c, d) for a, b, c, d in rows], sessions.RECORD).write.json(f"{tmp_path}/in")
    (tmp_path / "in" / "part-x.json").write_text('{"session": "s", "se')
    listing = sessions.drained(sessions.running_listing(sessions.records(spark, f"{tmp_path}/in")))
    assert {r.session: (r.records, r.title) for r in listing.collect()} == {"s": (3, "view"), "u": (1, "a")}
    write = sessions.upsert(spark, f"{tmp_path}/up")
    write(listing, 0)
    write(listing.where("session = 's'").withColumn("title", F.lit("new")), 1)
    assert {r.session: r.title for r in spark.read.parquet(f"{tmp_path}/up/v=1").collect()} == {"s": "new", "u": "a"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted(tuple(show(v) for v in r) for r in d[sorted(a.columns)].itertuples(index=False))
    assert rows(a) == rows(b)
