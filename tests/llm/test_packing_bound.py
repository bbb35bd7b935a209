"""Branches that can't beat the best filling cost no steps."""

from tracewright.llm import packing


def test_waste_bound_reaches_the_least_waste():
    counts = {46: 2, 101: 3, 247: 3, 287: 3, 336: 3, 352: 3, 361: 3}
    reach = {0}
    for n, c in counts.items():
        reach = {r + k * n for r in reach for k in range(c + 1)}
    got = packing.complete(sorted(counts), counts, 4396, 3000)
    assert sum(got) == max(r for r in reach if r <= 4396)
    assert all(got.count(n) <= c for n, c in counts.items())
