"""Words of whole texts as bytes, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are listed at a time.
BLOCK = 1 << 20
#: The characters that separate words (blanks; or all ASCII but letters and digits).
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NO_LETTERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def gaps(separators: bytes) -> bytes:
    """The table that turns every separator into a blank."""
    return bytes.maketrans(separators, b" " * len(separators))


def word_blocks(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, block by block; no word is cut, a null text has none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(table)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        if words := (data[at:end] if end < len(data) or at else data).split():
            yield words
        at = end
