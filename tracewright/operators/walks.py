"""Simple cycles and paths of a graph's strongly connected components, counted by sets of nodes instead of walk by walk.

A state is a set of nodes (a bit mask) and the node where a walk through just these ends; walks that agree on both are
one state with their number. `traversal` deals runs, or single components of very large runs, out over tasks.
"""

from __future__ import annotations

import numpy as np


#: States of all starts of a component that are carried on together; beyond, each start goes by itself.
TOGETHER = 500_000


class TooMany(Exception):
    """More states than allowed, or a number beyond 64 bits."""


def strong(src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    """Strongly connected components, each after all those that it leads to: depth-first, with a stack of its own."""
    onto: dict[int, list[int]] = {}
    for u, v in zip(src.tolist(), dst.tolist(), strict=True):
        onto.setdefault(u, []).append(v)
        onto.setdefault(v, [])
    index, low, open_, out, stack = {}, {}, set(), [], []
    for root in onto:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        open_.add(root)
        walk = [(root, iter(onto[root]))]
        while walk:
            u, rest = walk[-1]
            for v in rest:
                if v not in index:
                    index[v] = low[v] = len(index)
                    stack.append(v)
                    open_.add(v)
                    walk.append((v, iter(onto[v])))
                    break
                if v in open_:
                    low[u] = min(low[u], index[v])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[u])
                if low[u] == index[u]:
                    at = stack.index(u, max(0, len(stack) - 1 - (len(index) - index[u])))
                    out.append(stack[at:])
                    open_.difference_update(out[-1])
                    del stack[at:]
    return out


def distance(src: list[int], dst: list[int], start: int, end: int) -> int | None:
    """Edges of the shortest way from start to end, None where there is none."""
    onto: dict[int, list[int]] = {}
    for u, v in zip(src, dst, strict=True):
        onto.setdefault(u, []).append(v)
    level, seen, far = [start], {start}, 0
    while level:
        if end in seen:
            return far
        level = list({v for u in level for v in onto.get(u, ())} - seen)
        seen.update(level)
        far += 1
    return None


def matrix(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, those of most pairs first, and for each a mask of what it leads to; masks of more than 62 nodes are
    Python's integers."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    order = np.argsort(-np.bincount(at, minlength=len(nodes)), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    out = [0] * len(nodes)
    for a, b in zip(place[at[: len(src)]].tolist(), place[at[len(src) :]].tolist(), strict=True):
        out[a] |= 1 << b
    return nodes[order], np.asarray(out, np.int64 if len(nodes) <= 62 else object)


def reach(out: np.ndarray, start: int, within: int) -> int:
    """A mask of what `start` leads to within a mask of nodes."""
    seen, todo = 1 << start, [start]
    while todo:
        for v in bits(int(out[todo.pop()]) & within & ~seen):
            seen |= 1 << v
            todo.append(v)
    return seen


def bits(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


def turned(out: np.ndarray) -> np.ndarray:
    """For each node a mask of what leads to it."""
    back = np.zeros_like(out)
    for u in range(len(out)):
        for v in bits(int(out[u])):
            back[v] |= 1 << u
    return back


def onward(out: np.ndarray, masks: np.ndarray, ends: np.ndarray, counts: np.ndarray, within: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states one node further: a new node of `within`, equal states merged."""
    open_ = out[ends] & ~masks & within
    new = []
    for v in bits(int(np.bitwise_or.reduce(open_)) if len(open_) else 0):
        own = np.flatnonzero(open_ >> v & 1 == 1)
        mask, first = masks[own] | (1 << v), counts[own]
        order = np.argsort(mask, kind="stable")
        mask, first = mask[order], first[order]
        at = np.flatnonzero(np.concatenate([[True], mask[1:] != mask[:-1]]))
        new.append((mask[at], np.full(len(at), v), np.add.reduceat(first, at)))
    if not new:
        return masks[:0], ends[:0], counts[:0]
    out_ = tuple(np.concatenate(x) for x in zip(*new, strict=True))
    if len(out_[0]) > most:
        raise TooMany
    return out_


def cycles(src: np.ndarray, dst: np.ndarray, most: int) -> np.ndarray:
    """How many elementary cycles of each length a component has (at 0: none). Each is counted from its first node in
    the order of `matrix`, and only through nodes that lead there and back without the nodes before it."""
    nodes, out = matrix(src, dst)
    n, back = len(nodes), turned(out)
    found = np.zeros(n + 1, object)
    for start in range(n):
        later = ((1 << n) - 1) & ~((1 << start) - 1)
        within = reach(out, start, later) & reach(back, start, later)
        # Counts may pass 64 bits where more than 20 nodes are left.
        kind = np.int64 if within.bit_count() <= 20 else object
        masks, ends, counts = np.asarray([1 << start], out.dtype), np.asarray([start]), np.asarray([1], kind)
        length = 0
        while len(masks):
            length += 1
            closes = out[ends] >> start & 1 == 1
            found[length] += int(counts[closes].sum())
            masks, ends, counts = onward(out, masks, ends, counts, within, most)
    return found


def longest(src: np.ndarray, dst: np.ndarray, entries: np.ndarray, most: int) -> dict[tuple, int]:
    """(entry, node): edges of the longest simple path between them, for each entry; (None, node): from any node."""
    nodes, out = matrix(src, dst)
    every, best = (1 << len(nodes)) - 1, {}
    place = {int(x): k for k, x in enumerate(nodes)}
    for entry in [None, *entries.tolist()]:
        ends = np.arange(len(nodes)) if entry is None else np.asarray([place[entry]])
        masks, length = np.asarray([1 << k for k in ends.tolist()], out.dtype), 0
        counts = np.zeros(len(ends), np.int8)
        while len(masks):
            for v in np.unique(ends).tolist():
                best[entry, int(nodes[v])] = length
            masks, ends, counts = onward(out, masks, ends, counts, every, most)
            length += 1
    return best


def contracted(src: np.ndarray, dst: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, weights, first, to, closes) of a component's graph with each chain as one node that weighs as many: nodes
    that one other leads to and that lead to one, but none of `kept`. A set's weight is how many nodes it stands for.
    first and to: what a node leads to; self-loops are left out of them and told by closes."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, n = at[: len(src)], at[len(src) :], len(nodes)
    inner = (np.bincount(a, minlength=n) == 1) & (np.bincount(b, minlength=n) == 1) & ~np.isin(nodes, kept)
    head = np.arange(n)  # the node of its chain that stands for it
    onto = dict(zip(a[inner[a]].tolist(), b[inner[a]].tolist(), strict=True))
    led = set(b[inner[b] & inner[a]].tolist())
    for u in onto:
        v = u
        if u not in led:
            while (v := onto[v]) in onto:
                head[v] = u
    # What is left is a ring of its own, or nothing: it stays as it is.
    own, place = np.unique(head, return_inverse=True)
    weights = np.bincount(place)
    x, y = place[a], place[b]
    closes = np.zeros(len(own), bool)
    closes[x[a == b]] = True
    go = np.unique(x[(x != y)] * len(own) + y[x != y])
    first = np.searchsorted(go // len(own), np.arange(len(own) + 1))
    return nodes[own], weights, first, go % len(own), closes


def together(first: np.ndarray, to: np.ndarray, states: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """onward() of states of any starts, each a set with its last node in the lowest six bits. With counts they are added
    up, and a state goes on only through nodes after its set's least one: its start, so that set and end tell all."""
    masks, ends = states >> 6, states & 63
    deg = first[ends + 1] - first[ends]
    if deg.sum() > 4 * TOGETHER:
        raise TooMany
    at = np.repeat(first[ends] - (deg.cumsum() - deg), deg) + np.arange(deg.sum())
    bit, m = np.left_shift(np.int64(1), to[at]), np.repeat(masks, deg)
    open_ = m & bit == 0
    if counts is not None:
        open_ &= bit > (m & -m)
    new = ((m | bit) << 6 | to[at])[open_]
    if counts is None:
        new.sort()
        return new[np.concatenate([[True], new[1:] != new[:-1]])] if len(new) else new, None
    order = np.argsort(new)
    new, counts = new[order], np.repeat(counts, deg)[open_][order]
    own = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.empty(0, np.int64)
    return new[own], np.add.reduceat(counts, own) if len(own) else counts


def scales(weights: np.ndarray) -> list[np.ndarray]:
    """Tables of what sets weigh, for eleven of their nodes each."""
    bits_ = np.arange(2048)[:, None] >> np.arange(11) & 1
    return [bits_[:, : len(w)] @ w for w in (weights[k : k + 11] for k in range(0, len(weights), 11))]


def heavy(masks: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How many nodes each set stands for."""
    return sum((t[masks >> 11 * k & 2047] for k, t in enumerate(tables)), np.zeros(len(masks), np.int64))


def cycles_together(src: np.ndarray, dst: np.ndarray, most: int) -> np.ndarray:
    """cycles() of a component whose states of all starts are few and whose counts fit 64 bits for certain; else TooMany."""
    nodes, weights, first, to, closes = contracted(src, dst, np.empty(0, src.dtype))
    n, deg = len(nodes), np.diff(first)
    if n > 57 or np.log2(np.maximum(deg, 1)).sum() > 61:
        raise TooMany
    found, tables = np.zeros(int(weights.sum()) + 1, np.int64), scales(weights)
    np.add.at(found, weights[closes], 1)
    onto = np.zeros(n, np.int64)  # for each node a mask of what it leads to
    np.bitwise_or.at(onto, np.repeat(np.arange(n), deg), np.left_shift(np.int64(1), to))
    states, counts = np.left_shift(np.int64(64), np.arange(n)) | np.arange(n), np.ones(n, np.int64)
    while len(states):
        states, counts = together(first, to, states, counts)
        if len(states) > min(most, TOGETHER):
            raise TooMany
        masks = states >> 6
        home = onto[states & 63] & masks & -masks != 0
        np.add.at(found, heavy(masks[home], tables), counts[home])
    return found.astype(object)


def longest_together(src: np.ndarray, dst: np.ndarray, entries: np.ndarray, kept: np.ndarray, most: int) -> dict[tuple, int]:
    """longest() for the ends that count: those of `kept`, and the others that a longest path may end at. A path that
    begins or ends within a chain is no longer than one that takes the chain whole."""
    nodes, weights, first, to, _ = contracted(src, dst, np.union1d(entries, kept))
    if len(nodes) > 57:
        raise TooMany
    best, tables = {}, scales(weights)
    for entry in [None, *entries.tolist()]:
        ends = np.arange(len(nodes)) if entry is None else np.flatnonzero(nodes == entry)
        states, top = np.left_shift(np.int64(64), ends) | ends, np.full(len(nodes), -1)
        while len(states):
            np.maximum.at(top, states & 63, heavy(states >> 6, tables) - 1)
            states, _ = together(first, to, states)
            if len(states) > min(most, TOGETHER):
                raise TooMany
        best |= {(entry, int(nodes[k])): int(top[k]) for k in np.flatnonzero(top >= 0).tolist()}
    return best


def summed(found: np.ndarray) -> tuple[int, int, int, float]:
    """loop_count, min_loop, max_loop, avg_loop of counts by length."""
    lengths, total = np.flatnonzero(found), int(found.sum())
    if total >= 1 << 63:
        raise TooMany
    if not total:
        return 0, 0, 0, 0.0
    return total, int(lengths[0]), int(lengths[-1]), int((found * np.arange(len(found))).sum()) / total


def of_run(src: np.ndarray, dst: np.ndarray, most: int, *, loops: bool = True, paths: bool = True) -> tuple:
    """loop_count, min_loop, max_loop, avg_loop and longest_path of a graph; None where there are too many states."""
    comps = strong(src, dst)
    of = {v: k for k, c in enumerate(comps) for v in c}
    a, b = np.asarray([of[v] for v in src.tolist()]), np.asarray([of[v] for v in dst.tolist()])
    inner = {k: (src[(a == k) & (b == k)], dst[(a == k) & (b == k)]) for k in set(a[a == b].tolist())}
    stats, path = (None,) * 4, None
    if loops:
        try:
            found = np.zeros(max((len(c) for c in comps), default=0) + 1, object)
            for own in inner.values():
                try:
                    one = cycles_together(*own, most)
                except TooMany:
                    one = cycles(*own, most)
                found[: len(one)] += one
            stats = summed(found)
        except TooMany:
            pass
    if paths:
        try:
            path = through(comps, inner, src[a != b], dst[a != b], of, most)
        except TooMany:
            pass
    return (*stats, path)


def through(comps: list[list[int]], inner: dict[int, tuple], src: np.ndarray, dst: np.ndarray, of: dict, most: int) -> int:
    """Edges of the longest simple path: component by component in their order, within each from where it is entered."""
    arrive: dict[int, int] = {}  # the longest path that ends by entering a node from another component
    leave: dict[int, list[int]] = {}
    for u, v in zip(src.tolist(), dst.tolist(), strict=True):
        leave.setdefault(u, []).append(v)
    best = 0
    for k in range(len(comps) - 1, -1, -1):
        ends = {v: 0 for v in comps[k]}
        entries = [v for v in comps[k] if v in arrive]
        if len(comps[k]) > 1:
            try:
                found = longest_together(*inner[k], np.asarray(entries, np.int64), np.asarray([v for v in comps[k] if v in leave], np.int64), most)
            except TooMany:
                found = longest(*inner[k], np.asarray(entries, np.int64), most)
            for (entry, v), n in found.items():
                ends[v] = max(ends[v], n + (0 if entry is None else arrive[entry]))
        else:
            ends = {v: arrive.get(v, 0) for v in comps[k]}
        for u, n in ends.items():
            best = max(best, n)
            for v in leave.get(u, ()):
                arrive[v] = max(arrive.get(v, 0), n + 1)
    return best
