"""All metrics of a run against plain walks over its graph, on the event runs of sf0.001."""

from collections import Counter, defaultdict
from itertools import pairwise
from statistics import mean

import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics
from tracewright.plans import registry
from tracewright.sources import views

SF = "/root/testdata/sf0.001"
VIEW, EDIT = "str_replace_editor: view", "str_replace_editor: str_replace"


class Run:
    """Nodes in order of their first action, exec edges in order, hier edges by the rules of containment."""

    def __init__(self, actions):
        self.nodes, keys, self.edges = [], {}, []
        for a in actions:
            key = (a.label, tuple(sorted(a.args.items())), tuple(sorted(a.flags.items())))
            if key not in keys:
                keys[key] = len(self.nodes)
                self.nodes.append({"label": a.label, "args": a.args, "steps": [], "phases": []})
            n = keys[key]
            self.nodes[n]["steps"].append(a.step_idx)
            self.nodes[n]["phases"].append(a.phase)
            if a is not actions[0]:
                self.edges.append((last, n))
            last = n
        self.hier = list(self.contained())

    def contained(self):
        whole, ranges = [], defaultdict(list)
        for n, d in enumerate(self.nodes):
            if d["label"] == VIEW:
                path = d["args"]["path"]
                if "view_range" in d["args"]:
                    ranges[path].append((n, *map(int, d["args"]["view_range"].split("-"))))
                else:
                    whole.append((n, path))
        above = lambda path: max(((p.count("/"), -n) for n, p in whole if path.startswith(p + "/")), default=None)
        for n, path in whole:
            if best := above(path):
                yield -best[1], n
        last = {path: n for n, path in whole}
        for path, own in ranges.items():
            inner = set()
            for i, a1, a2 in own:
                for j, b1, b2 in own:
                    if i != j and a1 <= b1 and b2 <= a2 and not any(k not in (i, j) and a1 <= c1 and c2 <= a2 and c1 <= b1 and b2 <= c2 for k, c1, c2 in own):
                        yield i, j
                        inner.add(j)
            top = last.get(path, -above(path)[1] if above(path) else None)
            for n, _, _ in own:
                if n not in inner and top is not None:
                    yield top, n

    def codes(self):
        views_ = [n for n, d in enumerate(self.nodes) if d["label"] == VIEW]
        follow = defaultdict(dict)  # children in the order that the first edge of any kind led there
        for u, v in [*self.edges, *self.hier]:
            follow[u][v] = None
        held = defaultdict(set)
        for u, v in self.hier:
            held[u].add(v)
        out, into = {}, {v for _, v in self.hier}

        def walk(n, code):
            if n not in out:
                out[n] = code
                for k, c in enumerate([c for c in follow[n] if c in held[n]]):
                    walk(c, (*code, k))

        for k, root in enumerate([n for n in views_ if n not in into]):
            walk(root, (k,))
        return out, held

    def metrics(self):
        visits = sorted(((s, n, p) for n, d in enumerate(self.nodes) for s, p in zip(d["steps"], d["phases"], strict=True)), key=lambda x: x[0])
        phases = [p for _, _, p in visits]
        n, loc = len(phases), [i for i, p in enumerate(phases) if p == "localization"]
        thirds = [sum(i < n // 3 for i in loc), sum(n // 3 <= i < 2 * n // 3 for i in loc), sum(i >= 2 * n // 3 for i in loc)]
        zone = "none" if not loc else ["early", "middle", "late"][thirds.index(max(thirds))] if max(thirds) / len(loc) >= 0.5 else "mixed"
        often = [c for d in self.nodes if (c := d["phases"].count("localization"))]
        first = [min(d["steps"]) for d in self.nodes]
        m = {"node_count": len(self.nodes), "exec_edge_count": len(self.edges), "hier_edge_count": len(self.hier), "edge_count": len(self.edges) + len(self.hier), "step_count": max(s for s, _, _ in visits) + 1}
        m["avg_out_degree"] = len(set(self.edges)) / len(self.nodes)
        m["backedge_fraction"] = mean(u == v or first[v] < first[u] for u, v in self.edges) if self.edges else 0.0
        top = max(range(len(self.nodes)), key=lambda k: (len(self.nodes[k]["steps"]), -k))
        m |= {"most_freq_node": f"{top}:{self.nodes[top]['label']}", "most_freq_node_freq": len(self.nodes[top]["steps"])}
        m |= {"loc_focus_ratio": round(len(loc) / n, 2), "loc_dominant_zone": zone, "loc_num_clusters": sum(i - 1 not in loc for i in loc)}
        m |= {"loc_avg_node_freq": round(mean(often), 2) if often else 0, "repeated_view": any(c > 1 for c in often)}
        codes, held = self.codes()
        seen = [codes[k] for _, k, p in visits if p == "localization" and k in codes]
        leaf = [len(codes[k]) for _, k, p in visits if p == "localization" and k in codes and not held[k]]
        levels = Counter(map(len, seen)).values()
        m |= {"max_view_depth": max(leaf, default=0), "avg_view_depth": round(mean(leaf), 2) if leaf else 0, "max_view_span": max(levels, default=0), "avg_view_span": round(mean(levels), 2) if levels else 0}
        m["zoom_out"] = any(len(b) < len(a) and a[: len(b)] == b for a, b in pairwise(seen))
        ranges = defaultdict(list)
        for _, k, p in visits:
            if p == "localization" and "view_range" in self.nodes[k]["args"]:
                ranges[self.nodes[k]["args"]["path"]].append(tuple(map(int, self.nodes[k]["args"]["view_range"].split("-"))))
        m["scroll_behavior"] = any(b[0] <= a[1] for r in ranges.values() for a, b in pairwise(sorted(r)))
        patched = {d["args"]["path"] for d in self.nodes if d["label"] == EDIT}
        leaves = {self.nodes[k]["args"]["path"] for k in codes if not held[k]}
        m |= {"num_deep_zooms_without_edit": sum(not any(p in q for q in patched) for p in leaves), "back_and_forth_switch": False}
        return m | self.patches(visits)

    def patches(self, visits):
        at = {s: p for s, _, p in sorted(visits, key=lambda x: (x[0], x[1]))}
        own = [(s, self.nodes[k]["args"]) for s, k, p in visits if p == "patch"]
        failed = [a.get("edit_status", "").startswith("failure:") for _, a in own]
        streaks, run = [], 0
        for f in [*failed, False]:
            if not f and run:
                streaks.append(run)
            run = run + 1 if f else 0
        keys = [(a["path"], a["old_str"], a["new_str"]) for _, a in own]
        tried = defaultdict(list)
        for k, f in zip(keys, failed, strict=True):
            tried[k[0]].append(f)
        ways = Counter()
        for (s, _), (t, _), f, g in zip(own, own[1:], failed, failed[1:], strict=False):
            if f and not g:
                between = [p for x in range(s + 1, t) if (p := at.get(x, "unknown")) != "patch"]
                if between:
                    ways[">".join(p for i, p in enumerate(between) if not i or p != between[i - 1])] += 1
        return {
            "patch_total": len(own), "patch_success": failed.count(False), "fail_streak_count": len(streaks), "fail_streak_max": max(streaks, default=0), "fail_streak_avg": round(mean(streaks), 2) if streaks else 0,
            "fail_not_found": sum(a.get("edit_status") == "failure: not found" for _, a in own), "flip_flop": any(b == (a[0], a[2], a[1]) for a, b in pairwise(keys)),
            "repeat_failed_edit": any(f and k in keys[:i] for i, (k, f) in enumerate(zip(keys, failed, strict=True))), "abandonment": any(map(all, tried.values())), "fail_to_success_pattern": ways.most_common(1)[0][0] if ways else "N/A",
        }


def test_metrics_of_every_run(spark):
    actions = defaultdict(list)
    for a in views.rich_actions(spark, SF).orderBy("traj", "seq").collect():
        actions[a.traj].append(a)
    got = {r.traj: r.asDict() for r in registry.QUERIES["q_trajectory_metrics"](spark, SF).collect()}
    assert set(got) == set(actions)
    for traj, own in actions.items():
        for name, value in Run(own).metrics().items():
            assert got[traj][name] == pytest.approx(value), (traj, name)


def test_no_switch_is_possible():
    """Of three codes, the two longest shared beginnings of a pair are never longer than the third pair's alone."""
    import random

    rng = random.Random(2)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for _ in range(3000):
        a, b, c = ([rng.randrange(2) for _ in range(rng.randrange(1, 6))] for _ in range(3))
        assert not (shared(a, c) >= max(shared(a, b), shared(b, c)) and shared(a, b) != shared(b, c))


def test_segments(spark):
    nodes = spark.createDataFrame([("a", k, "todo_write" if k == 97 else "x") for k in range(260)] + [("b", k, "x") for k in range(40)], "traj string, node_ord long, label string")
    edges = spark.createDataFrame([("a", k, k, k + 1) for k in range(259)] + [("a", 900, 0, 259)] + [("b", k, k, k + 1) for k in range(39)], "traj string, edge_ord long, src long, dst long")
    pieces = metrics.segments(nodes, edges)
    by = defaultdict(list)
    for r in pieces.collect():
        by[r.traj, r.segment].append(r.node_ord)
    assert by["b", 0] == list(range(40)) and by["a", 0] == list(range(97)) and by["a", 1][0] == 96
    assert sorted({n for (t, _), own in by.items() if t == "a" for n in own}) == list(range(260)) and all(len(own) <= 150 for own in by.values())
    inside, anchors = metrics.segment_edges(edges, pieces)
    assert inside.where("traj = 'a' and edge_ord < 900").select("edge_ord").distinct().count() == 259
    assert {(r.node_ord, r.outside) for r in anchors.collect()} == {(0, 259), (259, 0)}


def test_sets_of_flags(spark):
    f = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False), ("d", False, False)], "traj string, x boolean, y boolean")
    assert {(r.name, r.n, float(r.pct)) for r in metrics.flag_totals(f, ["x", "y"]).collect()} == {("x", 2, 50.0), ("y", 1, 25.0), ("any", 2, 50.0)}
    m = spark.createDataFrame([("a", 2, True), ("b", 0, None)], "traj string, num_deep_zooms_without_edit long, zoom_out boolean")
    got = {r.traj: (r.OverlyDeepZoom, r.ZoomOut, r.Scroll) for r in metrics.inefficiencies(m, metrics.LOCALIZATION_FLAGS).collect()}
    assert got == {"a": (True, True, False), "b": (False, False, False)}
    runs = spark.createDataFrame([("b", 1), ("A", None), ("c", 5)], "traj string, step_count long")
    assert [[r.traj for r in metrics.sorted_listing(runs, o).collect()] for o in ("name", "steps", "-steps")] == [["A", "b", "c"], ["b", "c", "A"], ["c", "b", "A"]]
    p = spark.createDataFrame([("SA/m", "resolved", "under1h", "L, P", 40.0), ("OH/m", "resolved", "under1h", "P", 90.0)], "unit string, status string, difficulty string, text string, pct double")
    assert metrics.pattern_matrix(p, ["SA/m", "OH/m"]).first().asDict() == {"status": "resolved", "difficulty": "under1h", "SA/m": "L, P (40%)", "OH/m": "P (90%)"}
    flags = spark.createDataFrame([("a", 1)], "traj string, LV long")
    assert {r.traj: r.LV for r in metrics.with_transitions(m, flags).collect()} == {"a": 1, "b": 0}
