"""Decontamination of texts that repeat themselves, against plain edit distances."""

import random

import numpy as np
import pytest

from tracewright.llm import decontamination

PIECES = ["alpha", "beta", "gam", "delta", "-" * 30, "=" * 18, "  " * 8, "ab " * 10, "x"]


def least_edits(segment: bytes, text: bytes) -> int:
    """The least edits between the segment and any part of the text."""
    row = list(range(len(segment) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, s in enumerate(segment, 1):
            new.append(min(row[i - 1] + (s != c), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def made(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(PIECES) + rng.choice(" \n") for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    for _ in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["q" + text[at:], text[at + 1 :], "-" + text[at + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(6))
def test_repetitive_texts_equal_plain_edit_distances(seed):
    rng = random.Random(seed)
    items = [(k, made(rng, rng.randint(4, 14))) for k in range(6)] + [(6, "-" * 60), (7, " -" * 40), (8, "word " * 30)]
    index = decontamination.Index(items, 0.08, 96, 40)
    texts = []
    for k in range(6):
        quote = edited(rng, rng.choice(items)[1], rng.randint(0, 8))
        texts.append(made(rng, rng.randint(3, 20)) + quote + made(rng, 4) + rng.choice(["", "-", "=-", "word ", "ab "]) * rng.randint(300, 900) + f"end {k}")
    want = {}
    for k, text in enumerate(texts):
        for item, segment, e, _ in index.segments:
            n = least_edits(segment, decontamination.folded(text))
            if n <= e:
                want[k, item] = min(n, want.get((k, item), n))
    long_items = {item for item, *_ in index.segments}
    got = {key: edits for key, (edits, _, _) in decontamination.best_matches(index, texts).items() if key[1] in long_items}
    assert got == want and want


@pytest.mark.parametrize(("unit", "item"), [("-", 0), (" ", 1), ("word ", 2), ("-=", 3)])
def test_megabytes_of_one_unit(unit, item):
    items = [(0, "-" * 60), (1, "y" + " " * 150 + "x"), (2, "word " * 20), (3, "-=" * 30)] + [(10 + k, f"head {k} {'-' * 60} tail of item {k}") for k in range(20)]
    index = decontamination.Index(items, 0.08, 96, 40)
    found = decontamination.best_matches(index, ["begin " + unit * (5_000_000 // len(unit)) + f" {items[15][1]}"])
    assert (0, item) in found and (0, 21) in found
    edits, start, _ = found[0, 21]
    assert edits == 0 and start >= 5_000_000


def test_rules_between_paragraphs():
    items = [(k, f"head {k} {'-' * 60} tail of the item {k}") for k in range(20)]
    index = decontamination.Index(items, 0.08, 96, 40)
    text = "".join(f"para {k} here\n{'-' * 60}\n" for k in range(2000))
    found = decontamination.best_matches(index, [text, text + items[3][1]])
    # The items differ by their numbers alone, at most four edits, so a quote of one is a quote of all.
    assert found.keys() == {(1, k) for k in range(20)} and found[1, 3][0] == 0


def test_a_short_item_counts_at_its_first_place():
    index = decontamination.Index([(1, "--"), (2, "ab"), (3, "ab")], 0.08, 96, 40)
    assert decontamination.best_matches(index, ["xab ab ----" * 3]) == {(0, 1): (0, 7, 2), (0, 2): (0, 4, 2), (0, 3): (0, 4, 2)}


def test_alignment_of_whole_regions():
    assert decontamination.banded_distance(b"abcdef", b"xxabcdefyy", 2) == (0, 8)
    assert decontamination.banded_distance(b"abcdef", b"xxabdefyy", 2) == (1, 7)
    assert decontamination.banded_distance(b"abcdef", b"", 2) == (3, 0)
    assert np.array_equal(decontamination.grams(b"short"), np.empty(0, "<u8"))
