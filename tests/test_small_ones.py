"""Functions without a query: sizes, statuses, labels, details, means, windows over streams, arguments as VARIANTs."""

import json

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import aggregates, graph, metrics
from tracewright.sources import logs
from tracewright.streaming import sessions


def test_raw_sizes(spark):
    entry = {"a": [1, {"b": "é\n"}], "c": {}}
    texts = {"one": "a\nb", "two": "a\nb\n", "odd": "a\r\nb\x0bc d", "none": "", "entry": json.dumps(entry), "bad": "{"}
    rows = spark.createDataFrame(list(texts.items()), "traj string, text string")
    assert {r.traj: (r.n_lines, r.n_chars) for r in logs.raw_sizes(rows).collect()} == {k: (len(t.splitlines()), len(t)) for k, t in texts.items()}
    pretty = json.dumps(entry, indent=2, ensure_ascii=False)
    got = {r.traj: (r.n_lines, r.n_chars) for r in logs.raw_sizes(rows, entries=True).collect()}
    assert got["entry"] == (len(pretty.splitlines()), len(pretty)) and got["bad"] == (1, 1)


def test_kinds_of_logs_by_path(spark):
    paths = {"/x/a.traj": "sa", "/x/output.jsonl": "oh", "/x/a.traj.json": "msa", "/x/rollout-1.jsonl": "codex", "/x/s.jsonl": "claude", "/x/a.txt": None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", logs.agent_of(F.col("p")).alias("a")).collect()
    assert {r.p: r.a for r in rows} == paths


def test_outcomes_that_are_told(spark):
    rows = [(True, 0, "fine", "success", "failure"), (None, 2, "", "success", "failure"), (False, 0, "", None, "success"), (None, 0, "", "failure", "failure"), (None, None, "Exit code: 3", None, "failure"), (None, None, "exit code 0", None, "success"), (None, None, "x", None, None), (None, None, None, "neutral", "neutral")]
    f = spark.createDataFrame(rows, "e boolean, c int, o string, d string, want string")
    for r in f.select("want", text.explicit_outcome(F.col("e"), F.col("c"), F.col("o"), F.col("d")).alias("got")).collect():
        assert r.got == r.want


def test_ranges_of_views_in_variants(spark):
    cases = {'{"view_range": [1, 2]}': None, '{"view_range": [1, "2"]}': "failure: invalid view range", '{"view_range": [1]}': "failure: invalid view range", '{"view_range": "1-2"}': "failure: invalid view range", '{"view_range": [1.5, 2]}': "failure: invalid view range", "{}": None}
    f = spark.createDataFrame([(a, w) for a, w in cases.items()], "a string, want string").withColumn("args", F.parse_json("a"))
    for r in f.select("a", "want", text.edit_status(F.lit(text.EDITOR), F.lit("view"), F.lit("ok"), args=F.col("args")).alias("got")).collect():
        assert r.got == r.want, r.a


def test_graphs_of_variants_equal_graphs_of_maps(spark):
    view = lambda p, r=None: ("str_replace_editor: view", {"path": p} | ({"view_range": r} if r else {}), "localization")
    edit = ("str_replace_editor: str_replace", {"path": "/a/b.py", "old_str": "x", "new_str": "y", "edit_status": "success"}, "patch")
    own = [view("/a"), view("/a/b.py"), view("/a/b.py", [1, 100]), view("/a/b.py", [10, 50]), view("/a/b.py", [10, 50]), edit, view("/a/c.py")]
    rows = [("t", k, k, label, json.dumps(args), False, phase, "t", "o", "neutral") for k, (label, args, phase) in enumerate(own)]
    base = spark.createDataFrame(rows, "traj string, seq long, step_idx long, label string, a string, has_cd boolean, phase string, thought string, observation string, outcome string")
    typed = base.withColumn("args", F.parse_json("a")).withColumn("flags", F.parse_json(F.lit("{}"))).drop("a")
    maps = base.withColumn("args", F.from_json("a", "map<string,string>")).withColumn("flags", F.create_map().cast("map<string,string>")).drop("a")
    told = []
    for f in (typed, maps):
        o, n, e, h = graph.build_graph(f)
        assert sorted((r.src, r.dst) for r in h.collect()) == [(0, 1), (0, 5), (1, 2), (2, 3)]
        told.append(metrics.trajectory_metrics(o, n, e, h).first().asDict())
    assert told[0] == told[1] and told[0]["node_count"] == 6 and told[0]["patch_success"] == 1 and told[0]["max_view_depth"] == 4


def test_labels_and_details(spark):
    f = spark.createDataFrame([("view", [1, 2], "/a/b/c.py"), ("ls", [1, 2, 3, 4, 9], None)], "label string, steps array<int>, path string")
    assert [r[0] for r in f.select(text.compact_label(F.col("label"), F.col("steps"), F.col("path"))).collect()] == ["view b/c.py [1,2]", "ls [1,2,3,..,9]"]
    assert f.select(text.clean_text(F.lit("a\x00b\tc\x7f\n"))).first()[0] == "a�b\tc�\n"
    flags = spark.createDataFrame([(v,) for v in ("1", "True", " yes ", "0", "no", "2.5", "-1", None)], "x string").select(aggregates.truthy("x")).collect()
    assert [r[0] for r in flags] == [True, True, True, False, False, True, False, False]
    o = spark.createDataFrame([("t", 0, 1, 5, "a", "th", "ob", "success"), ("t", 0, 0, 4, "a", "th0", "ob0", "neutral")], "traj string, node_ord long, seq long, step_idx long, label string, thought string, observation string, outcome string")
    assert [(v.step_idx, v.thought, v.action, v.outcome) for v in graph.step_details(o).first().visits] == [(4, "th0", "a", "neutral"), (5, "th", "a", "success")]
    edges = spark.createDataFrame([("t", 0, 1, s, False) for s in (3, 5, 7, 7)] + [("t", 0, 2, 4, False), ("t", 0, 3, 1, True), ("t", 5, 6, 1, False)], "traj string, src long, dst long, step_idx long, is_first_in_step boolean")
    assert {(r.dst, r.n, r.label) for r in graph.busy_labels(edges, 4).collect()} == {(1, 4, "3..7 (3)"), (2, 1, "4")}
    m = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 4.0), ("b", None, 6.0)], "g string, x double, y double")
    assert tuple(aggregates.means(m, ["x", "y"]).first()) == (2.0, 5.0)
    assert {r.g: (r.x, r.y) for r in aggregates.means(m, ["x", "y"], ["g"]).collect()} == {"a": (2.0, 4.0), "b": (None, 6.0)}


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "session string, seq long, ts timestamp, label string, phase_class string"
    row = lambda s, at, kind="loc": (s, 0, at, "l", kind)
    batches = [[row("a", "2024-01-01 10:00:00"), row("a", "2024-01-01 10:01:00"), row("b", "2024-01-01 10:02:00", "patch")], [row("a", "2024-01-01 12:00:00")], [row("a", "2024-01-01 10:03:00")], [row("a", "2024-01-01 14:00:00")], [row("a", "2024-01-01 16:00:00")]]
    found = {"phases": [], "sessions": []}
    for rows in batches:
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        for name, fn in (("phases", sessions.phase_counts), ("sessions", sessions.session_windows)):
            take = lambda batch, n, name=name: found[name].extend(tuple(map(str, r)) for r in batch.collect())
            fn(sessions.records(spark, f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    # The row of 10:03 came when the watermark stood at 11:50.
    assert ("2024-01-01 10:00:00", "loc", "2") in found["phases"] and ("2024-01-01 10:00:00", "patch", "1") in found["phases"]
    assert ("a", "2024-01-01 10:00:00", "2024-01-01 10:31:00", "2") in found["sessions"]
    assert sum(r[0] == "2024-01-01 10:00:00" for r in found["phases"]) == 2
