"""Token counts of fields and sections, from one encoding of the whole document.

A document is one text: its header fields, one a line, then its body. It is encoded once, whole,
so tokens are those that training would see. The byte length of each token gives its byte span,
the byte span its character span; sections are character intervals, here one for each header
field and each line of the body. The interval join of the two sorted lists is a binary search
inside the task that read the document; nothing is shuffled.

Rule for tokens that cross a boundary: a token belongs to the section in which its first
character lies (a token that starts inside a character, to that character's section), and the
line break that ends a section belongs to it. So counts of a document's sections add up to its
tokens. ``n_crossing`` counts the tokens of a section that reach into a later one.

Defined cases: a null field is empty, any other value is written out (0 and False too); an empty text is one empty section; repeated rows are
counted each; a section may have 0 tokens; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table

SECTIONS = "doc_id long, field string, section int, start int, end int, n_tokens int, n_crossing int"


def attributed(token_lengths: np.ndarray, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its end.

    ``starts`` are the sections' first characters, ascending from 0; tokens come as byte lengths.
    """
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character in which each byte lies
    ends = np.cumsum(token_lengths)
    first, last = char[ends - token_lengths], char[ends - 1]
    own, to = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    return np.bincount(own, minlength=len(starts)), np.bincount(own[to > own], minlength=len(starts))


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, header: list[str], body: str = "text") -> DataFrame:
    """One row per header field and per line of the body; spans count characters of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_file).read_bytes().splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(token) for token in ranks]
        n = len(header)
        for batch in batches:
            ids, names, cols = [], [], [[] for _ in range(5)]
            fields = [c.to_pylist() for c in batch.columns[1:-1]]
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.columns[-1], strict=True)):
                lines = ["" if f[i] is None else str(f[i]).replace("\n", " ") for f in fields] + (text.as_py() or "").encode("utf-8", "replace").decode().split("\n")
                whole = "\n".join(lines)
                sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
                sizes[-1] -= 1
                ends = np.cumsum(sizes)
                tokens = lengths[encode(whole)]
                counts, crossing = attributed(tokens, whole.encode(), ends - sizes) if len(tokens) else (np.zeros(len(lines), np.int64),) * 2
                ids += [doc_id] * len(lines)
                names += [*header, *[body] * (len(lines) - n)]
                section = np.concatenate([np.zeros(n, np.int64), np.arange(len(lines) - n)])
                for c, x in zip(cols, (section, ends - sizes, ends, counts, crossing), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), *(pa.array(np.concatenate(c) if c else [], pa.int32()) for c in cols)], names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"])

    return plain(docs, ["doc_id", *header, body]).mapInArrow(run, SECTIONS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's header and of the lines of its body, by document and field."""
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["source", "lang"])
    return found.select("doc_id", "field", "section", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "n_tokens", "n_crossing")
