"""Walks over whole event runs, against brute force."""

from collections import defaultdict
from itertools import permutations

import pandas as pd

from tracewright.plans import registry

SF = "/root/testdata/sf0.001"


def runs():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    return {int(t): g.event_type.tolist() for t, g in e.groupby("user_id")}


def test_walks_read_whole_runs(spark):
    own = runs()
    assert max(map(len, own.values())) > 12
    cycles, longest, components, shortest = {}, {}, {}, {}
    for t, labels in own.items():
        step = set(zip(labels, labels[1:]))
        nodes = list(dict.fromkeys(labels))
        paths = [p for n in range(1, len(nodes) + 1) for p in permutations(nodes, n) if all(x in step for x in zip(p, p[1:]))]
        shortest[t] = min((len(p) - 1 for p in paths if p[0] == nodes[0] and p[-1] == nodes[-1]), default=None)
        if not step:
            continue
        found = [len(p) for p in paths if (p[-1], p[0]) in step and min(p, key=nodes.index) == p[0]]
        cycles[t] = (len(found), min(found, default=0), max(found, default=0), round(sum(found) / len(found), 6) if found else 0.0, False)
        longest[t] = (max(map(len, paths)) - 1, False)
        reach = {(p[0], p[-1]) for p in paths if len(p) > 1} | {x for x in step if x[0] == x[1]}
        onloop = defaultdict(set)
        for a in nodes:
            for b in nodes:
                if (a, b) in reach and (b, a) in reach:
                    onloop[a] |= {a, b}
        components[t] = (len({frozenset(v) for v in onloop.values()}), len(onloop))
    got = lambda name: {int(r[0]): tuple(r)[1:] for r in registry.QUERIES[name](spark, SF).collect()}
    assert got("q_cycles") == cycles
    assert got("q_longest_path") == longest
    assert got("q_loop_components") == components
    assert {t: x[0] for t, x in got("q_shortest_path").items()} == shortest
