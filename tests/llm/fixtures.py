"""Small documents with nulls, empties, ties, repeats and clashing columns, for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def rows(seed=7, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 3, 20, 60, 120, 300])) for _ in range(n)]
    passage = prose(rng, 80)
    texts += [prose(rng, 30) + "\n" + passage + " " + prose(rng, 30) for _ in range(8)]
    texts += [texts[-1], texts[-1], texts[20], texts[20]]
    base = prose(rng, 200, 10**6).split()
    for _ in range(6):
        w = list(base)
        w[rng.randrange(200)] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", "don't  stop\n\n now", "é ñ 日本 <|endoftext|> x", prose(rng, 6000)]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def docs(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def odd(spark):
    """A null and a repeated identifier, repeated rows, and columns named like ones that operators add."""
    names = "doc_id long, text string, shard string, n_words string, score string, class_id string, label string, piece string, length string, batch string"
    some = [(None, "a b c"), (None, "a b c"), (5, "x y z " * 40), (5, "x y z " * 40), (5, None), (-3, "q " * 120), (9, "x y z " * 40)]
    return spark.createDataFrame([(*r, *["mine"] * 8) for r in some], names)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
