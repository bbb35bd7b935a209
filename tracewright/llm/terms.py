"""Terms of whole texts, as bytes: runs of letters (digits, if wanted) and of anything beyond ASCII, only A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator


def folding(*, digits: bool) -> bytes:
    """A table for bytes.translate(): A-Z become a-z, other ASCII that is no term's becomes a blank."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    table[97:123] = table[65:91] = bytes(range(97, 123))
    if digits:
        table[48:58] = bytes(range(48, 58))
    return bytes(table)


def term_lists(raw: bytes | None, table: bytes, piece: int = 4 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each piece of about so many bytes; pieces end between terms."""
    at, raw = 0, raw or b""
    while at < len(raw):
        end = min(at + piece, len(raw))
        while end < len(raw) and table[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(table).split()
        at = end
