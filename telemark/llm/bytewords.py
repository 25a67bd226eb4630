"""Words of UTF-8 bytes, split by ASCII separators: a byte of an ASCII character
is never part of another character, so one translation table folds case and
marks separators at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE = 1 << 20     # bytes of a text whose words are held as objects at a time


def table(space, end=(), mark: int = 10) -> bytes:
    """A translation: A to Z in lower case, ``space`` characters to a space,
    ``end`` characters to ``mark``."""
    t = bytearray(range(256))
    t[65:91] = bytes(range(97, 123))
    for c in space:
        t[c] = 32
    for c in end:
        t[c] = mark
    return bytes(t)


def raw(column: pa.Array) -> list:
    """A string column as bytes objects, null as None."""
    return column.cast(pa.binary()).to_pylist()


def slices(text: bytes, size: int = SLICE, end: bytes = b" ") -> Iterator[bytes]:
    """A translated text in slices that end at ``end``; a run without it stays whole."""
    at = 0
    while at < len(text):
        cut = text.find(end, at + size) + 1 or len(text)
        yield text[at:cut]
        at = cut
