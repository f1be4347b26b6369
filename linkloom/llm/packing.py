"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Every document is tokenised once, whole. Its ids (with the end id) are cut into pieces whose
lengths fall into *reciprocal-capacity classes*: class ``k`` holds lengths in
``(capacity / (k + 1), capacity / k]``, and each of its sequences takes exactly ``k`` pieces.
As every class fills its sequences with a fixed number of pieces, workers place pieces
independently: a piece needs only its rank within its class, never the state of a bin.

Cuts follow one rule, so they depend on a document's own length alone: full sequences first;
a remainder stays whole where its class wastes little, else a piece that fills its slot exactly
is taken off and the rest is looked at again. The last, incomplete sequence of each class is
broken up: those leftovers (fewer than ``capacity * (1 + ln capacity)`` pieces, whatever the
input) are dealt by a hash into groups of about ``LEFTOVERS``, and each group is placed by best fit.

Shuffled are piece descriptions only (some 50 bytes each), never texts or ids.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed
as often as they occur; an empty table gives no pieces; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table, written
from linkloom.llm.word_bpe import WordBpe

CAPACITY = 4096
END_ID = 2
#: A piece may waste this share of its slot, or this many tokens, before it is cut once more.
WASTE_SHARE, WASTE_TOKENS = 0.01, 3

#: Leftover pieces that are placed together.
LEFTOVERS = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int"


def slot_class(length: int, capacity: int) -> int:
    """The class of a length: how many such pieces one sequence takes."""
    return capacity // length


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of ``n`` ids, in order; they add up to ``n``."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = slot_class(rest, capacity)
        waste = capacity // k - rest
        if waste <= max(WASTE_TOKENS, WASTE_SHARE * rest):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: its place in the document, its class and the CRC of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                for length in cut(n, capacity):
                    rows.append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, slot_class(length, capacity)))
                    at += length
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"])

    return plain(docs, ["doc_id", "text"]).mapInArrow(run, PIECES)


def best_fit(capacity: int):
    """Leftovers of a group, longest first, each into the fullest sequence that still takes it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        room: list[tuple[int, int]] = []  # (tokens left, sequence), sorted
        seq, at, made = [], [], 0
        for length in pdf["length"]:
            i = bisect_left(room, (length, -1))
            left, s = room.pop(i) if i < len(room) else (capacity, made)
            made += s == made
            seq.append((int(key[0]) << 24) + s)
            at.append(capacity - left)
            insort(room, (left - length, s))
        return pdf.assign(sequence_id=pd.Series(seq, index=pdf.index, dtype="int64"), offset=pd.Series(at, index=pdf.index, dtype="int64")).drop(columns=["group"])

    return run


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives every piece its sequence and its offset there.

    The rank of a piece within its class is the number of pieces in earlier buckets of the
    class plus its rank within its own bucket. There are about sqrt(n) buckets, so neither a
    bucket nor the list of bucket counts ever holds more than about sqrt(n) rows of a class.
    """
    per_class = found.groupBy("k").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c"), F.sum(F.col("c") % F.col("k"))).first()
    n, n_left = (x or 0 for x in per_class)
    buckets = max(1, math.isqrt(n))
    found = found.withColumn("b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    order = ["doc_id", "start", "ids_crc32", "length"]
    ranked = found.withColumn("i", F.row_number().over(W.partitionBy("k", "b").orderBy(*order)) - 1)
    counts = found.groupBy("k", "b").agg(F.count(F.lit(1)).alias("c"))
    by_class = W.partitionBy("k")
    before = counts.select("k", "b", (F.sum("c").over(by_class.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(by_class).alias("in_class"))
    ranked = ranked.join(before, ["k", "b"]).withColumn("rank", F.col("before") + F.col("i"))
    whole = F.col("rank") < F.col("in_class") - F.col("in_class") % F.col("k")
    ranked = ranked.withColumn("left", ~whole)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("not left").withColumn("sequence_id", F.shiftleft(F.col("k").cast("long"), 44) + F.floor(F.col("rank") / F.col("k")).cast("long"))
    within = W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = full.withColumn("offset", F.sum("length").over(within) - F.col("length")).select(*columns, "sequence_id", "offset")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    as_text = F.col("doc_id").cast("string").alias("doc_id")  # pandas has no whole numbers with nulls
    group = F.pmod(F.xxhash64("k", "rank"), F.lit(max(1, math.ceil(n_left / LEFTOVERS)))).alias("group")
    rest = ranked.where("left").select(as_text, *columns[1:], group).groupBy("group").applyInPandas(best_fit(capacity), schema.replace("doc_id long", "doc_id string"))
    return full.unionByName(rest.withColumn("doc_id", F.col("doc_id").cast("long")))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all documents; one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
