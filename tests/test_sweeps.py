"""Nested ranges by a sweep, leaf paths by an index of grams, blocked scans, gapped patterns: against brute force."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import containment, graph, patterns, phases, scans


def nested(own):
    for i, a, b in own:
        for o, c, d in own:
            if i != o and c <= a and b <= d and not any(k not in (i, o) and c <= x and y <= d and x <= a and b <= y for k, x, y in own):
                yield (o, i)


def test_nested_ranges_equal_all_pairs(spark):
    rng = random.Random(2)
    files = {f"f{k}": [(n, lo, lo + rng.randrange(8)) for n, lo in ((n, rng.randrange(8)) for n in range(rng.randrange(1, 12)))] for k in range(300)}
    frame = spark.createDataFrame([("t", f, n, a, b) for f, own in files.items() for n, a, b in own], "traj string, path string, node long, lo long, hi long")
    got = {}
    for r in containment.nested_ranges(frame).collect():
        got.setdefault(r.path, []).append((r.o_node, r.i_node))
    for f, own in files.items():
        assert sorted(got.get(f, [])) == sorted(nested(own)), own


def test_a_hundred_thousand_ranges_in_one_file(spark):
    n = 100_000
    frame = spark.range(n).selectExpr("'t' traj", "'f' path", "id node", "id lo", f"{3 * n} - id hi")
    began = time.time()
    got = containment.nested_ranges(frame)
    assert tuple(got.agg(F.count("*"), F.min(F.col("i_node") - F.col("o_node")), F.max(F.col("i_node") - F.col("o_node"))).first()) == (n - 1, 1, 1)
    assert time.time() - began < 60


def test_leaves_equal_all_pairs(spark):
    rng = random.Random(3)
    path = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    leaves = [(f"t{k % 3}", path(rng.randrange(1, 12))) for k in range(200)]
    patched = [(f"t{k % 3}", path(rng.randrange(1, 40))) for k in range(40)] + [("t9", "x")]
    leaves += [("t4", "alone"), ("t4", "alone")]
    got = {r.traj: r.n for r in containment.deep_zooms_without_edit(spark.createDataFrame(leaves, "traj string, path string"), spark.createDataFrame(patched, "traj string, path string"), q=3).collect()}
    want = {t: len({p for x, p in leaves if x == t and not any(y == t and p in q for y, q in patched)}) for t in {x for x, _ in leaves}}
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scans_equal_plain_windows(spark, block):
    rng = random.Random(block)
    rows = [(f"t{t}", k, k // 2, rng.choice("abcd"), rng.choice(["loc", "ctx", "ctx", "patch", "general", "plan"])) for t in range(4) for k in range(rng.choice([1, 30, 60]))]
    actions = spark.createDataFrame(rows, "traj string, seq long, step_idx long, label string, phase_class string")
    told = lambda f: sorted(map(str, f.select(*sorted(f.columns)).collect()))
    plain = phases.resolved(actions)
    assert told(scans.resolved(actions, block=block)) == told(plain)
    assert told(scans.phase_runs(plain, block=block)) == told(phases.phase_runs(plain))
    occurrences = graph.node_occurrences(plain)
    assert told(scans.node_occurrences(plain)) == told(occurrences)
    assert told(scans.edges(occurrences, block=block)) == told(graph.edges(occurrences))
    numbered = scans.numbered(actions.drop("step_idx").withColumnRenamed("seq", "at"), ["at"], partitions=5)
    assert numbered.where("at <> seq").isEmpty() and numbered.count() == len(rows)
    for how, fn in (("sum", F.sum), ("min", F.min), ("max", F.max)):
        value = F.when(F.col("label") != "a", F.ascii("label"))
        w = phases.by_seq()
        for before, upto in ((False, 0), (True, -1)):
            assert told(scans.running(actions, value, name="x", how=how, before=before, block=block)) == told(actions.withColumn("x", fn(value).over(w.rowsBetween(Window.unboundedPreceding, upto))))


def test_gapped_patterns_equal_brute_force(spark):
    rng = random.Random(9)
    seqs = [("g", f"r{k}", [rng.choice("LPV") for _ in range(rng.randrange(11))]) for k in range(12)] + [("h", f"r{k}", list("LPLPLPLPLPLPLP")) for k in range(2)] + [("one", "r", list("LPV" * 20)), ("none", "r", [])]
    frame = spark.createDataFrame(seqs, "grp string, traj string, seq array<string>")
    for support in (0.4, 1.0):
        want = {}
        for g in ("g", "h"):
            own = [{c for n in range(1, len(s) + 1) for c in combinations(s, n)} for x, _, s in seqs if x == g]
            for p in set().union(*own):
                n = sum(p in o for o in own)
                if n / len(own) >= support:
                    want[g, p] = n
        want["one", tuple("LPV" * 20)] = 1
        assert {(r.grp, tuple(r.pattern)): r.n for r in patterns.gapped(frame, support).collect()} == want


def test_contiguous_patterns_of_any_length(spark):
    long = list("LPV" * 12)
    frame = spark.createDataFrame([("g", "a", long), ("g", "b", ["X", *long]), ("g", "c", []), ("g", "d", list("LP"))], "grp string, traj string, seq array<string>")
    slices = lambda s: {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    own = [slices(long), slices(["X", *long]), set(), slices(list("LP"))]
    want = {p: sum(p in o for o in own) for p in set().union(*own)}
    got = {tuple(r.pattern): (r.n, r.support) for r in patterns.contiguous(frame, 0.5, first_len=5).collect()}
    assert got == {p: (n, n / 4) for p, n in want.items() if n >= 2}
