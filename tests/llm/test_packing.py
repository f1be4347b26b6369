import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import packing
from linkloom.llm.packing import cut, pack
from linkloom.llm.word_bpe import LAST, SAFE, WordBpe
from tests.llm.conftest import ODD, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["it's we'll X'S don't O'Reilly <|endoftext|> a", "½²³ ªº ǅ İstanbul ÀÉ", "\x85a\xa0b", "naïve  é x é", "'s's 12ab3 a_b-c", "中文 a", "a\0b", "<|x", "ﬁ ΣΑΣ", "🙂 ok", "!!! ... a,b;c"]


def test_ids_equal_the_tokenizer(rnd):
    coder, tokenizer = WordBpe(PATH), Tokenizer.from_file(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzABCéàüßñ0123'.,-_ \n\t#$"
    words = sorted(tokenizer.get_vocab())[::40]
    texts = HARD + ["".join(rnd.choice(letters) for _ in range(300)) for _ in range(150)] + [" ".join(w.removesuffix("</w>") + rnd.choice(["", "ing", "s"]) for w in words)]
    for t in texts:
        assert coder.encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_ids_of_every_safe_letter():
    """Also of those that aren't, which go to the tokenizer."""
    coder, tokenizer = WordBpe(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(0x21, LAST + 80)):
        for t in (c, f"a{c}b", f"{c}{c} 1{c}2", f"x {c}", f"'{c}s", f"{c}\n{c}A"):
            assert coder.encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)
    assert all(ord(x) <= LAST for c in SAFE for x in c.lower()) and "\u0181" not in SAFE and "é" in SAFE


@pytest.mark.parametrize("n", [1, 2, 100, 1000, 2047, 2048, 2049, 4095, 4096, 4097, 10_000])
def test_cuts(n):
    parts = cut(n)
    assert sum(parts) == n and min(parts) > 0 and max(parts) <= 4096
    slots = [4096 // (4096 // p) for p in parts]
    assert sum(s - p for s, p in zip(slots, parts, strict=True)) <= max(3, 0.01 * n)


def test_round_trip(make, rnd):
    texts = [*ODD, *HARD, *[prose(rnd, rnd.choice([3, 40, 300, 3000])) for _ in range(60)]]
    docs = make(*texts, extra=True)
    rows = pack(docs, PATH).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts, 1):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows) >= 0.9 * 4096 * (len(by_sequence) - 1)


def test_repeats_and_empty(make):
    docs = make("a b c", "a b c")
    both = pack(docs.unionAll(docs), PATH).collect()
    assert len(both) == 4 and len({(r["sequence_id"], r["offset"]) for r in both}) == 4
    assert pack(docs.limit(0), PATH).count() == 0
    assert pack(make((None, "x"), (3, None)), PATH).count() == 2


def test_leftovers_in_groups(make, rnd, monkeypatch):
    """Groups of leftovers don't share sequences, and nothing overlaps."""
    monkeypatch.setattr(packing, "LEFTOVERS", 7)
    rows = pack(make(*[prose(rnd, rnd.choice([3, 40, 300, 700])) for _ in range(80)]), PATH).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
