"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy arrays of nodes.

Statistics are counted over each whole text. A bounded sample of labelled rows (`max_rows`, those with the least hash of
doc_id) trains shallow trees with logistic loss on quantile bins. For statistics where more is never better (symbols,
repeated lines and words) the trees are monotonic: a split whose sides break the order is refused, and the middle of its
sides bounds what grows below. A document fails outright under the base rules (fewer than 50 words, or more than half
of its words in repeated three-word windows), else the trees decide.

Defined results: null and empty texts have no words and fail; without labels of both kinds every document that passes
the base rules is kept, with score 0.5; a null doc_id is scored but never a training row; rows that repeat are scored
each and train once for each. An empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import words, worker_cache, written

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_short_lines"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "words_a_line", "upper", "digits", "marks", "distinct", "short_lines"]
#: -1: the score may only fall as the statistic rises.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
BLANK = " \t\n\x0b\x0c\r"


def repeated_words(w: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first included."""
    runs = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(runs)) == len(runs):
        return 0
    seen: set[tuple] = set()
    twice = {r for r in runs if r in seen or seen.add(r)}
    covered, upto = 0, 0
    for i, r in enumerate(runs):
        if r in twice:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    blanks = sum(text.count(c) for c in BLANK)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=128) if raw else np.zeros(128, np.int64)
    return (
        len(w),
        len(text) - blanks,
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(w),
        len(lines),
        int(kinds[65:91].sum()),
        int(kinds[48:58].sum()),
        int(kinds[33] + kinds[63]),
        len(set(w)),
        sum(len(x) < 20 for x in lines),
    )


def counted(docs: DataFrame) -> DataFrame:
    def count(batches):
        worker_cache("quality")
        for batch in batches:
            columns = list(zip(*[statistics(t) for t in batch.column(1).to_pylist()], strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(list(c), pa.int64()) for c in columns]], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    n, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, n / lines, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / n, c["n_distinct"] / n, c["n_short_lines"] / lines], 1)


class Trees:
    """Nodes of all trees in flat arrays; a leaf points to itself."""

    def __init__(self, start: float = 0.0):
        self.start, self.roots = start, []
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self.depth = 0

    def node(self) -> int:
        k = len(self.feature)
        for column, x in ((self.feature, 0), (self.cut, np.inf), (self.left, k), (self.right, k), (self.value, 0.0)):
            column.append(x)
        return k

    def flat(self) -> dict[str, np.ndarray]:
        return {"feature": np.asarray(self.feature, np.int32), "cut": np.asarray(self.cut), "left": np.asarray(self.left, np.int32), "right": np.asarray(self.right, np.int32), "value": np.asarray(self.value), "roots": np.asarray(self.roots, np.int32)}

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality, all rows and trees at once."""
        if not hasattr(self, "_flat"):
            self._flat = self.flat()
        f = self._flat
        if not len(f["roots"]):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        at = np.broadcast_to(f["roots"], (len(x), len(f["roots"]))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, f["feature"][at]] <= f["cut"][at], f["left"][at], f["right"][at])
        return 1 / (1 + np.exp(-(self.start + f["value"][at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 8) -> Trees:
    rate_1 = y.mean() if len(y) else 0.5
    if rate_1 in (0.0, 1.0) or not len(y):
        return Trees()
    model = Trees(float(np.log(rate_1 / (1 - rate_1))))
    model.depth = depth
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1)
    raw = np.full(len(y), model.start)
    sign = [MONOTONE.get(f, 0) for f in FEATURES]

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def split(node: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        value = leaf(g.sum(), h.sum(), low, high)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + l2) * v * v)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                gs, hs, ns = (np.bincount(binned[rows, k], w, len(e) + 1).cumsum()[:-1] for w in (g, h, None))
                vl = np.clip(-gs / (hs + l2), low, high)
                vr = np.clip(-(g.sum() - gs) / (h.sum() - hs + l2), low, high)
                gain = gain_of(gs, hs, vl) + gain_of(g.sum() - gs, h.sum() - hs, vr) - gain_of(g.sum(), h.sum(), value)
                ok = (ns >= least) & (len(rows) - ns >= least)
                if sign[k]:
                    ok &= (vr - vl) * sign[k] >= 0
                gain = np.where(ok, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, at, vl[at], vr[at]))
        if best[1] is None:
            model.value[node] = rate * value
            raw[rows] += rate * value
            return
        k, at, vl, vr = best[1]
        left, right = model.node(), model.node()
        model.feature[node], model.cut[node], model.left[node], model.right[node] = k, float(edges[k][at]), left, right
        middle = (vl + vr) / 2
        sides = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[sign[k]]
        go = binned[rows, k] <= at
        split(left, rows[go], level + 1, *sides[0])
        split(right, rows[~go], level + 1, *sides[1])

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        root = model.node()
        model.roots.append(root)
        split(root, np.arange(len(y)), 0, -np.inf, np.inf)
    return model


def fitted(counts: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees from at most `max_rows` labelled rows."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = counts.join(known, "doc_id").orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id", *COUNTS).limit(max_rows).toPandas()
    return grow(features({c: sample[c].to_numpy() for c in COUNTS}), sample["quality"].to_numpy(np.float64))


def judged(docs: DataFrame, labels: DataFrame, *, cut: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """doc_id, the statistics, base_failed, score (probability of good quality) and kept."""
    counts = written(counted(docs))
    model = docs.sparkSession.sparkContext.broadcast(fitted(counts, labels, max_rows))

    def score(batches):
        worker_cache("quality")
        for batch in batches:
            s = model.value.score(features({c: batch.column(c).to_numpy() for c in COUNTS}))
            yield batch.append_column("score", pa.array(s))

    scored = counts.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= cut))
