"""Token counts by a Viterbi search that counts and builds no tokens.

An Aho-Corasick automaton finds every vocabulary piece in a unit of text; dynamic programming keeps, for each place,
the best score and how many tokens lead there. Ties go as in the tokenizers library's unigram model: of equal paths to
a place the one whose last piece begins first stays; a character that is no piece costs ten below the least score, and
stands for one token for each of its bytes. Blanks become U+2581, which only begins pieces, so units between blanks are
counted alone and each is counted once (a worker keeps `MEMO_BYTES` of them).

The vocabulary is the pieces and scores of a public model file, whose path is a parameter.

Defined results: null and empty texts have no tokens; rows that repeat each give a row; an empty table gives none.
Extra columns are not read.
"""

from __future__ import annotations

from itertools import filterfalse

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import worker_cache

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Bytes of units kept by a worker, with about so many for each besides its characters.
MEMO_BYTES, ENTRY_BYTES = 96_000_000, 130


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}
        self.held = 0

    def tokens(self, unit: str) -> int:
        """Of one unit, its mark included."""
        size = len(unit)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, piece in self.find.iter(unit):
            ends[end].append(piece)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        for end, pieces in enumerate(ends):
            top, n, single = None, 0, False
            for length, score in sorted(pieces, reverse=True):  # the longest begins first
                score += best[end + 1 - length]
                single |= length == 1
                if top is None or score > top:
                    top, n = score, count[end + 1 - length] + 1
            if not single and (top is None or best[end] + self.unknown > top):
                top, n = best[end] + self.unknown, count[end] + len(unit[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, n
        return count[size]

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        split = []
        for t in texts:
            units = t.split(" ") if t else []
            split.append(units[1:] if units and not units[0] else units)
        for units in split:
            for unit in set(filterfalse(self.memo.__contains__, units)):
                self.memo[unit] = self.tokens(MARK + unit)
                self.held += 2 * len(unit) + ENTRY_BYTES
        return [sum(map(self.memo.__getitem__, units)) for units in split]


def counter(path: str) -> Counter:
    own = worker_cache("tokencounts")
    if path not in own:
        own[path] = Counter(vocabulary(path))
    return own[path]


def token_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens."""

    def count(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = []
            for at in range(0, len(texts), 500):
                sizes += counter(vocab).counts(texts[at : at + 500])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
