"""Cycles, simple paths and components against brute force on random graphs, whole and by joins; large and dense ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import traversal, walks


def brute(pairs):
    """loop_count, min, max, avg, longest path, and the component of each node on a cycle."""
    onto, lengths, best = {}, [], 0
    for u, v in pairs:
        onto.setdefault(u, set()).add(v)
        onto.setdefault(v, set())

    def walk(start, u, seen, n):
        nonlocal best
        best = max(best, n)
        for v in onto[u]:
            if v == start:
                if start == min(seen):
                    lengths.append(n + 1)
            elif v not in seen:
                walk(start, v, seen | {v}, n + 1)

    for s in onto:
        walk(s, s, {s}, 0)
    far = {s: set() for s in onto}
    for s in onto:
        todo = [s]
        while todo:
            for v in onto[todo.pop()] - far[s]:
                far[s].add(v)
                todo.append(v)
    comp = {u: min(v for v in onto if v in far[u] and u in far[v]) for u in onto if u in far[u]}
    stats = (len(lengths), min(lengths, default=0), max(lengths, default=0), sum(lengths) / len(lengths) if lengths else 0.0)
    return (*stats, best), comp


def random_graphs(n, seed):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        size = rng.randrange(1, 9)
        ids = rng.sample(range(1000), size)
        out[k] = {(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randrange(1, 3 * size + 1))}
    # Chains with a ring in them, rings alone, two rings that share a node, tails.
    out[n] = {(k, k + 1) for k in range(6)} | {(4, 2)}
    out[n + 1] = {(0, 1), (1, 2), (2, 0), (5, 6), (6, 5), (9, 9)}
    out[n + 2] = {(0, 1), (1, 0), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 0)}
    out[n + 3] = {(1, 1), (1, 2), (2, 2)}
    return out


def frame(spark, graphs):
    return spark.createDataFrame([(f"g{k}", u, v) for k, g in graphs.items() for u, v in g], "traj string, src long, dst long")


@pytest.mark.parametrize(("small", "n"), [(traversal.SMALL, 150), (0, 4)])
def test_walks_and_components_equal_brute_force(spark, small, n):
    graphs = random_graphs(n, n)
    if not small:  # every join is a job: few graphs, of all shapes
        graphs = {k: g for k, g in graphs.items() if k in (0, n, n + 2)}
    pairs = frame(spark, graphs)
    pairs = pairs.unionByName(pairs.limit(20))  # repeats count once
    want = {f"g{k}": brute(g) for k, g in graphs.items()}
    got = {r[0]: tuple(r[1:]) for r in traversal.walk_metrics(pairs, small=small).collect()}
    for k, (stats, _) in want.items():
        assert got[k][:3] == stats[:3] and math.isclose(got[k][3], stats[3]) and got[k][4] == stats[4], (k, graphs)
    found = {k: {} for k in want}
    for r in traversal.components(pairs, small).collect():
        found[r.traj][r.node] = r.component
    assert found == {k: comp for k, (_, comp) in want.items()}


@pytest.mark.parametrize("small", [traversal.SMALL, 0])
def test_a_ring_of_ten_thousand_nodes(spark, small):
    n = 10_000
    ring = spark.range(n).select(F.lit("ring").alias("traj"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(n, n + 3000).select(F.lit("ring").alias("traj"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = traversal.components(ring.unionByName(tail).unionByName(spark.createDataFrame([("ring", 5, n)], "traj string, src long, dst long")), small)
    assert tuple(got.agg(F.count("*"), F.min("component"), F.max("component"), F.max("node")).first()) == (n, 0, 0, n - 1)


def test_all_pairs_of_twenty_nodes():
    """As many cycles as choices of a set times the orders around it; a path through all."""
    for n, most in ((2, 10), (7, 10**6), (12, 10**6)):
        src, dst = (x.ravel() for x in np.nonzero(~np.eye(n, dtype=bool)))
        found = walks.cycles(src, dst, most)
        assert found.tolist()[2:] == [math.comb(n, k) * math.factorial(k - 1) for k in range(2, n + 1)]
        assert walks.of_run(src, dst, most)[4] == n - 1
    src, dst = (x.ravel() for x in np.nonzero(np.ones((20, 20))))
    found = walks.cycles(src, dst, traversal.STATES)
    assert found.tolist()[1:] == [math.comb(20, k) * math.factorial(k - 1) for k in range(1, 21)]
    assert walks.of_run(src, dst, 1000) == (None,) * 5


def test_more_than_sixty_two_nodes():
    n = 80
    src = np.concatenate([np.arange(n), np.arange(0, n, 20)])
    dst = np.concatenate([(np.arange(n) + 1) % n, (np.arange(0, n, 20) + 10) % n])
    got = walks.of_run(src, dst, traversal.STATES)
    # Four places to go the long or the short way; a path may end just before one that it came over.
    assert got[:4] == (16, 44, 80, 62.0) and got[4] == 79


def test_large_runs_that_have_too_many_states(spark):
    full = {(a, b) for a in range(8) for b in range(8)}
    graphs = {0: full | {(7, 100), (100, 101)}, 1: {(0, 1), (1, 0)}}
    for small in (traversal.SMALL, 20):
        got = {r.traj: (r.loop_count, r.longest_path) for r in traversal.walk_metrics(frame(spark, graphs), max_states=30, small=small).collect()}
        assert got == {"g0": (None, None), "g1": (1, 1)}, small
    over = traversal.cycle_metrics(frame(spark, graphs), max_frontier=30).where("truncated").collect()
    assert [r.traj for r in over] == ["g0"] and over[0].avg_loop is None


def test_a_run_with_one_action(spark):
    """No edges: zeros, and nothing is cut off."""
    from tracewright.operators import graph, metrics

    rows = [("one", 0, 0, "a", {}, {}, False, "general", "t", "o", "neutral"), ("two", 0, 0, "a", {}, {}, False, "general", "t", "o", "neutral"), ("two", 1, 1, "b", {}, {}, False, "general", "t", "o", "neutral")]
    actions = spark.createDataFrame(rows, "traj string, seq long, step_idx long, label string, args map<string,string>, flags map<string,string>, has_cd boolean, phase string, thought string, observation string, outcome string")
    got = {r.traj: (r.loop_count, r.min_loop, r.max_loop, r.avg_loop, r.longest_path, r.truncated) for r in metrics.trajectory_metrics(*graph.build_graph(actions)).collect()}
    assert got == {"one": (0, 0, 0, 0.0, 0, False), "two": (0, 0, 0, 0.0, 1, False)}
