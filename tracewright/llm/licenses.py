"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A text's words are cut into overlapping blocks, for each template at least twice as long as it is, so that a template
that stands there whole lies within one block (and at least `block` words). A block matches a template when it holds at
least `threshold` of the template's distinct words. All words are put in one global order, rarest first by their counts
over all documents. Then

- prefix filter: a match shares a word of the template's first n - overlap + 1 in that order;
- length filter: a block needs as many distinct template words as the overlap the template asks for;
- positional filter: from the first word shared in the prefix, what follows in the template and what follows in the
  block must still reach the overlap;

and only what passes is verified by the whole intersection. Only template words can match, so blocks are reduced to
them, in the global order, first. Templates and phrases are parameters; templates may span lines and be of any length.

Defined results: a null text is empty; no word gives n_words 0, null places, score 0 and no blocks; rows that repeat each
give a row; an empty table gives none. Of extra columns those named like added ones become in_<name>, the rest pass
through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import unclash

#: The phrases that the scan counts, each with its label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices in common use, and the label a block gets that holds enough of one.
TEMPLATES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without written permission"),
]
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCKS = "array<struct<share:double,label:string,first:bigint,words:bigint>>"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]


def spaced(text: Column) -> Column:
    """The words in lower case (A to Z only) with a space before each and after the last."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), BREAK, " ")


def count_of(text: Column, what: str) -> Column:
    return F.size(F.split(text, what, -1)) - 1


def template_words(text: str) -> list[str]:
    """A template's words as texts have them."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def scanned(docs: DataFrame, *, threshold: float = 0.8, block: int = 32, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment) and blocks
    (label, share, first word and number of words of each text block that matches a template)."""
    docs = unclash(docs, ADDED)
    spark = docs.sparkSession
    whole = {label: template_words(text) for label, text in templates}
    sets = {label: list(dict.fromkeys(own)) for label, own in whole.items() if own}
    vocabulary = sorted({w for own in sets.values() for w in own})
    lines = docs.withColumn("_words", spaced(F.col("text")))

    # The global order: how often each template word stands in all texts, rarest first, ties by the word.
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    counted = lines.select(F.explode(F.split("_words", " ")).alias("word")).join(F.broadcast(known), "word").groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets = {label: sorted(own, key=order.get) for label, own in sets.items()}
    overlap = {label: math.ceil(threshold * len(own) - 1e-9) for label, own in sets.items()}
    prefix = {label: own[: len(own) - overlap[label] + 1] for label, own in sets.items()}
    by_length: dict[int, list[str]] = {}
    for label in sets:
        n = max(block, 1 << (2 * len(whole[label]) - 1).bit_length())
        by_length.setdefault(n, []).append(label)

    def matching(own: Column, start: Column, length: int, label: str) -> Column:
        """What a block gives for a template, null unless it passes the filters in turn and reaches the overlap."""
        words, need = sets[label], overlap[label]
        first = F.element_at(F.array_intersect(literal(prefix[label]), own), 1)
        left = F.least(F.lit(len(words)) - F.array_position(literal(words), first), F.size(own) - F.array_position(own, first))
        both = F.size(F.array_intersect(literal(words), own))
        found = F.struct((both / F.lit(len(words))).alias("share"), F.lit(label).alias("label"), start.cast("long").alias("first"), F.lit(length).cast("long").alias("words"))
        return F.when(F.arrays_overlap(own, literal(prefix[label])), F.when((F.size(own) >= need) & (left + 1 >= need), F.when(both >= need, found)))

    some = sorted({w for own in prefix.values() for w in own})
    holds = F.col("_words").rlike(f" (?:{'|'.join(map(re.escape, some))}) ") if some else F.lit(False)
    lines = lines.withColumn("_all", F.when(holds, F.split(F.trim("_words"), " ")))

    def matches(length: int, labels: list[str]) -> Column:
        """All that the blocks of one length give."""
        in_order = literal(sorted({w for label in labels for w in sets[label]}, key=order.get))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_all") - 1), F.lit(length // 2))
        reduced = F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_intersect(in_order, F.slice("_all", s + 1, length)).alias("own")))
        each = lambda b: F.filter(F.array(*[matching(b["own"], b["s"], length, x) for x in labels]), lambda x: x.isNotNull())
        return F.flatten(F.transform(reduced, each))

    parts = [F.array().cast(BLOCKS), *[matches(n, labels) for n, labels in by_length.items()]]
    lines = lines.withColumn("_found", F.when(F.col("_all").isNotNull(), F.concat(*parts)).otherwise(F.array().cast(BLOCKS)))

    places = [count_of(F.col("_words"), f" {p}(?= )") for p in phrases]
    firsts, lasts = [], []
    for p in phrases:
        has = F.col("_words").contains(f" {p} ")
        firsts.append(F.when(has, count_of(F.substring_index("_words", f" {p} ", 1), " ")))
        lasts.append(F.when(has, count_of(F.col("_words"), " ") - count_of(F.substring_index("_words", f" {p} ", -1), " ") - F.lit(len(p.split()) + 1)))
    base = F.array_sort(F.filter(F.array(*[F.when(F.col("_words").contains(f" {p} "), F.lit(label)) for p, label in phrases.items()]), lambda x: x.isNotNull()))
    found = F.array_sort(F.array_distinct(F.concat(base, F.transform("_found", lambda x: x["label"]))))
    return lines.select(
        *docs.columns,
        (F.octet_length("_words") - F.octet_length(F.replace(F.col("_words"), F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_distinct(base), ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.transform("_found", lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share"), x["first"].alias("first"), F.least(x["words"], F.size("_all") - x["first"]).alias("words"))).alias("blocks"),
    )
