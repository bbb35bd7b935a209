"""Token ids of whole texts, through the tokenizers library and a bounded memory of word pieces.

Both public tokenizers cut a text into pre-tokens before merging, and a merge never crosses such a cut. A blank that a
non-blank follows is always a cut; so is the place between a letter and signs that a blank follows, and between a line
end with letters on both sides (signs may stand before it) and these. A text is the join of the units between such
cuts, each unit is encoded by the library once, and its ids are reused. tests/llm compare this with encoding whole texts.

Texts are cut and units are told apart in Arrow; Python sees each distinct unit of a batch once, and the library only
units that are new. A worker's memory is bounded in bytes, of units and ids together.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm.common import worker_cache

#: Bytes of units and ids kept in memory by one Python worker; beyond it the memory starts anew.
MEMO_BYTES = 150_000_000
#: What a kept unit takes besides its characters and ids.
ENTRY_BYTES = 160
#: What begins a unit that has no blank before it. Texts that hold one, or a token that the file adds to the vocabulary
#: (found before any cut), are cut at blanks only.
BARE = "\0"
_SAFE, _UNSAFE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


class Encoder:
    """ids(texts) gives little-endian unsigned 32-bit ids for each text, as bytes; flat(texts) the same in one array."""

    def __init__(self, path: str, memo: int | None = None):
        self.memo = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = "Removed" in str(self.tokenizer.pre_tokenizer)
        # One token of a word is its first or its last: which ids are such can be read off the vocabulary.
        mark = (lambda t: t.endswith("</w>")) if self.drops_blanks else (lambda t: t.startswith("\u0120"))
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            if k < len(self.edge):
                self.edge[k] = mark(token)
        added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join([re.escape(BARE), *map(re.escape, added)]), re.IGNORECASE)
        self._forget()

    def _forget(self) -> None:
        #: Units by text, as places in the pool.
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size, self.units = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.held = 0

    def _keep(self, units: list[str], ids: list[bytes]) -> None:
        new, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + len(new), np.uint32)])
        if self.units + len(units) > len(self.first):
            more = np.empty(self.units + len(units), np.int64)
            self.first, self.size = np.concatenate([self.first[: self.units], more]), np.concatenate([self.size[: self.units], more])
        self.pool[self.used : self.used + len(new)] = new
        self.size[self.units : self.units + len(units)] = sizes
        self.first[self.units : self.units + len(units)] = self.used + sizes.cumsum() - sizes
        self.known.update(zip(units, range(self.units, self.units + len(units)), strict=True))
        self.used, self.units = self.used + len(new), self.units + len(units)
        self.held += 4 * len(new) + ENTRY_BYTES * len(units) + 2 * sum(map(len, units))

    def _each(self, units: list[str]) -> list[bytes]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array("I", e.ids).tobytes() for e in fast(units, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, each with a blank before it: one pre-token each, so many go in one call."""
        out: list[bytes] = []
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        some = [runs[at : at + 200] for at in range(0, len(runs), 200)]
        for own, found in zip(some, fast([" " + " ".join(r) for r in some], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            at = np.flatnonzero(self.edge[np.minimum(ids, len(self.edge) - 1)])
            cuts = [0, *(at + 1).tolist()] if self.drops_blanks else [*at.tolist(), len(ids)]
            if len(at) == len(own) and cuts[0] == 0 and cuts[-1] == len(ids):
                data = ids.tobytes()
                out += [data[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self._each([" " + r for r in own])
        return out

    def _learn(self, units: list[str]) -> None:
        letters = [u for u in units if u.isalpha()]
        if letters:
            self._keep(letters, self._letters(letters))
        whole = [u for u in units if not u.isalpha()]
        if whole:
            before = "" if self.drops_blanks else " "
            self._keep(whole, self._each([u[1:] if u[:1] == BARE else before + u for u in whole]))

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All units, and where each text's begin and end. A unit has a blank before it unless it begins with BARE."""
        odd = [k for k, t in enumerate(texts) if self.added.search(t) or (not self.drops_blanks and _UNSAFE.search(t))]
        rare = set(odd)
        usual = np.asarray([k for k in range(len(texts)) if k not in rare], np.int64)
        plain = pa.array([texts[k] for k in usual.tolist()], pa.large_string())
        if self.drops_blanks:
            plain = pc.replace_substring(plain, "\n", " ")
        else:
            plain = pc.replace_substring_regex(plain, r"(\pL)([[:punct:]]*)\n(\pL)", f"\\1 {BARE}\\2\n {BARE}\\3")
            plain = pc.binary_join_element_wise(pa.scalar(BARE, pa.large_string()), plain, pa.scalar("", pa.large_string()))
        plain = pc.replace_substring_regex(plain, r"(\pL)([[:punct:]]+) ", f"\\1 {BARE}\\2 ")
        lists = pc.split_pattern(plain, " ")
        values, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        starts, stops = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        starts[usual], stops[usual] = edges[:-1], edges[1:]
        if odd:
            own = [texts[k].split(" ") if self.drops_blanks else _SAFE.split(texts[k]) for k in odd]
            own = [[BARE + u[0], *[BARE + " " * (not self.drops_blanks) + v if v[:1] == BARE else v for v in u[1:]]] for u in own]
            more = np.cumsum([len(values), *map(len, own)])
            starts[odd], stops[odd] = more[:-1], more[1:]
            values = pa.concat_arrays([values, pa.array([u for units in own for u in units], pa.large_string())])
        return values, starts, stops

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end in them."""
        values, starts, stops = self._split([t or "" for t in texts])
        if self.held > (self.memo or MEMO_BYTES):
            self._forget()
        coded = values.dictionary_encode()
        units = coded.dictionary.to_pylist()
        self._learn([u for u in units if u not in self.known])
        place = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))[coded.indices.to_numpy()]
        n = self.size[place]
        ends = n.cumsum()
        out = self.pool[np.repeat(self.first[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate([[0], ends])
        return out, edges[starts], edges[stops]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, starts, stops = self.flat(texts)
        return [out[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def encoder(path: str, memo: int | None = None) -> Encoder:
    """One for each worker and file, kept between tasks; memo: bytes of units and ids that it keeps (None: MEMO_BYTES)."""
    own = worker_cache("encoding")
    if path not in own:
        own[path] = Encoder(path)
    own[path].memo = memo
    return own[path]


def narrow(ids: np.ndarray, width: int) -> np.ndarray:
    """The ids in so many bytes each; one that doesn't fit is an error."""
    if len(ids) and int(ids.max()) >= 1 << (8 * width):
        raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
    return ids.astype(f"<u{width}")


def batches(texts: list, chars: int = 4_000_000):
    """Runs (from, to) of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
