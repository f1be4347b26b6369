"""Ids of a word-wise BPE tokenizer with white space dropped, computed word by word.

The tokenizer splits a text at white space, then into words, and never joins across either, so
the ids of a text are those of its words in order. Texts for which this isn't plainly the same (characters beyond the Latin blocks, control characters, strings of special tokens) go to
the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from pathlib import Path

#: Up to this character, composition and white space are the same in all libraries.
LAST = 0x24F
#: Lower-casing too, of characters that it leaves below LAST.
SAFE = "".join(c for c in map(chr, range(0xA1, LAST + 1)) if max(map(ord, c.lower())) <= LAST)
UNUSUAL = re.compile(rf"[^\n\r\t\x20-\x7e{SAFE}]|<\|")


def of_kind(kind: str) -> str:
    """The characters up to LAST whose Unicode category begins with ``kind``, for a character class."""
    return "".join(c for c in map(chr, range(0x21, LAST + 1)) if unicodedata.category(c)[0] == kind)


#: The tokenizer's own word pattern, over the characters up to LAST.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of_kind('L')}]+|[{of_kind('N')}]|[^\s{of_kind('L')}{of_kind('N')}]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: ASCII that needs no closer look.
USUAL = bytes([9, 10, 13, *range(0x20, 0x7F)])


def unusual(text: str) -> bool:
    if text.isascii():
        return "<|" in text or bool(text.encode().translate(None, USUAL))
    return bool(UNUSUAL.search(text))


class WordBpe:
    """A word-wise BPE vocabulary, run by tiktoken, which merges several times faster.

    tiktoken knows bytes and ranks only, so the end of a word becomes a byte of its own, zero,
    which no usual text holds. Joining it to a word's last byte has the lowest ranks, hence
    comes first; all further merges keep the order they have in the tokenizer's file.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        byte_of, vocabulary = {c: b for b, c in enumerate(byte_letters())}, model["vocab"]

        def as_bytes(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(map(byte_of.__getitem__, word)) + b"\0" * (word != token)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = byte_letters()
        ids = [vocabulary[c] for c in letters] + [vocabulary[f"{c}</w>"] for c in letters] + [vocabulary[a + b] for a, b in pairs]
        units = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(256)] + [as_bytes(a + b) for a, b in pairs]
        self.ids = np.asarray(ids, "<u4")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks={u: i for i, u in enumerate(units)}, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if unusual(text):
            return self.np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = WORDS.findall(text.lower())
        return self.ids[self.merge("\0".join(words) + "\0")].tobytes() if words else b""
