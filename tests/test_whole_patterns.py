"""Patterns over whole phase runs, against brute force."""

from collections import Counter, defaultdict

from tracewright.operators import patterns
from tracewright.plans import registry

SF = "/root/testdata/sf0.001"


def test_patterns_read_whole_sequences(spark):
    own = defaultdict(lambda: defaultdict(list))
    for r in registry.QUERIES["q_phase_runs"](spark, SF).orderBy("traj", "run_no").collect():
        own[("resolved", "unresolved", "unsubmitted")[r.traj % 3]][r.traj].append(r.abbr)
    want, longest = {}, {}
    for grp, seqs in own.items():
        n = Counter(p for s in seqs.values() for p in {"".join(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)})
        want |= {(grp, p): c for p, c in n.items() if c / len(seqs) >= 0.3}
        longest[grp] = max(len(p) for g, p in want if g == grp)
    assert max(len(s) for seqs in own.values() for s in seqs.values()) > 20
    assert {(r.grp, r.pattern): r.n for r in registry.QUERIES["q_contiguous_patterns"](spark, SF).collect()} == want
    assert {r.grp: len(r.pattern) for r in registry.QUERIES["q_longest_patterns"](spark, SF).collect()} == longest


def test_patterns_have_no_greatest_length(spark):
    long = ["L", "P"] * 15
    seqs = spark.createDataFrame([("g", "a", long, [1] * 30), ("g", "b", [*long, "V"], [2] * 31)], "grp string, traj string, seq array<string>, lens array<long>")
    r = patterns.longest_patterns(seqs, patterns.contiguous(seqs, 0.6)).first()
    assert (r.pattern, r.lower) == (long, [1] * 30)
