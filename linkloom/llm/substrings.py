"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at line ends);
a sentence of more than ``PART`` words is cut further, after the word with the least hash of every
``PART`` words in a row, so that no part is longer and the same passage is cut alike wherever it
stands. Every run of ``run`` sentences is hashed (lower-cased, white space made even), however short
they are; longer runs consist of these. (A caller may ask for ``min_words`` as well: then from every
sentence on the shortest run that has them counts, and likewise the shortest that ends with it.) The
first place of a hash is the least (doc_id, row, position); every sentence covered by a run that
stands at any other place goes. ``row`` is a hash of the text where several rows share a doc_id, else 0.

Any passage of ``4 * PART + 1`` words that stands twice has a run in common: its first and last cut
in common are at most ``PART`` words from its ends, so three parts at least lie between them.

Repeats within a document are settled in the task that reads it, so each document sends a hash
once. First places come from one aggregation with partial sums, and only those of hashes that several
documents have go on. The join back is an equi-join; the few hashes that very many documents have, at
most ``HOT`` of them, are broadcast instead, so their rows stay where they are. Texts are never
shuffled for the spans.

Defined cases: null, empty and short texts have no runs; rows without a doc_id have no place and
lose nothing; of rows that share a doc_id each is judged by its own text; rows that repeat whole
are one place and don't repeat one another; an empty table gives no spans; other columns are ignored by
``repeated_spans`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.minhash import mixed
from linkloom.llm.shared import held, plain, table, written

#: Sentences of a run, and the words it must have; both at least.
RUN, MIN_WORDS = 3, 1
#: Hashes that are broadcast, at most: each stands for more than a HOT-th of all rows.
HOT = 10_000
#: Ids that several rows share, up to which they are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words beyond which a sentence is cut further; no part has more.
PART = 12
END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of a text's sentences, in characters."""
    out, at = [], 0
    for m in [*END.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out += parts(text, at, end) if end - at > 2 * PART else [(at, end)]
        at = m.end() if m else end
    return out


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    words = list(WORD.finditer(text, start, end))
    if len(words) <= PART:
        return [(start, end)]
    out, at = [], start
    for i in cuts([zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) for m in words]):
        if i < len(words) - 1:
            out.append((at, words[i].end()))
            at = words[i].end()
    return [*out, (at, end)]


def cuts(h: list[int]) -> list[int]:
    """Places of the least value of every ``PART`` in a row, the last of equal ones."""
    out, least = [], -1
    for i in range(PART - 1, len(h)):
        if least > i - PART and h[i] > h[least]:
            continue
        if least > i - PART:
            least = i
        else:
            least = min(range(i, i - PART, -1), key=h.__getitem__)
        out.append(least)
    return out


def runs_of(words: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest runs from each sentence on, and up to each."""
    n, upto = len(words), np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n + 1)
    behind = np.maximum(at + run, np.searchsorted(upto, upto + min_words))
    first = np.minimum(at - run, np.searchsorted(upto, upto - min_words, "right") - 1)
    a, b = at[behind <= n], at[first >= 0]
    both = np.unique(np.concatenate([a * (n + 1) + behind[a], first[b] * (n + 1) + b]))
    return both // (n + 1), both % (n + 1) - 1


SPANS = "h long, doc_id long, row long, pos int, last int, start int, end int, again boolean"
#: An odd factor of the rolling hash of runs, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """One row per run of sentences; ``again``: this document has had the same run before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                at = sentences(text)
                n = len(at)
                if doc_id is None or n < run:
                    continue
                split = [text[a:b].lower().split() for a, b in at]
                h = np.fromiter((xxh64_intdigest(" ".join(s).encode("utf-8", "surrogatepass")) for s in split), np.uint64, len(split))
                w = np.fromiter(map(len, split), np.int64, len(split))
                pos, last = runs_of(w, run, min_words)
                powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * powers(FACTOR)[:n])])
                key = mixed((upto[last + 1] - upto[pos]) * powers(INVERSE)[pos] + (last - pos + 1).astype(np.uint64)).view(np.int64)
                again = np.ones(len(pos), bool)
                again[np.unique(key, return_index=True)[1]] = False
                span = np.asarray(at, np.int32)
                for c, x in zip(cols, (key, np.full(len(pos), doc_id), np.full(len(pos), row), pos.astype(np.int32), last.astype(np.int32), span[pos, 0], span[last, 1], again), strict=True):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, types, strict=True)], names=["h", "doc_id", "row", "pos", "last", "start", "end", "again"])

    return placed(plain(docs, ["doc_id", "text"])).select("doc_id", "row", "text").mapInArrow(work, SPANS)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``: a hash of the text where several rows share a doc_id, else 0."""
    shared = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("shared_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shared_id")
    shared = written(shared, "shared-ids")
    n = shared.count()
    if not n:
        return docs.withColumn("row", F.lit(0).cast("long"))
    side = F.broadcast(shared) if n <= BROADCAST_IDS else shared
    joined = docs.join(side, F.col("doc_id") == F.col("shared_id"), "left")
    return joined.withColumn("row", F.when(F.col("shared_id").isNotNull(), F.xxhash64("text")).otherwise(0)).drop("shared_id")


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that stand elsewhere first: doc_id, row, pos, last, start, end, first_doc_id."""
    found = written(spans(docs, run, min_words), "spans")
    # The join carries a run's place as two numbers; rows of eight-byte fields take half as much again.
    low = F.lit(0xFFFFFFFF)
    two = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    sent = found.select("h", "doc_id", "row", two(F.col("pos"), F.col("start")).alias("a"), two(F.col("last"), F.col("end")).alias("b"))
    place = F.struct("doc_id", "row")
    places = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count(F.lit(1)).alias("times"))
    first = written(places.where("first < final").select("h", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), "times"), "firsts")
    often = F.col("times") > max(100, math.ceil(found.count() / HOT))
    hot = F.broadcast(first.where(often).select(F.col("h").alias("hot_h"), "first_doc_id", "first_row"))
    met = sent.join(hot, F.col("h") == F.col("hot_h"), "left")
    columns = ["doc_id", "row", "a", "b", "first_doc_id", "first_row"]
    at_once = met.where("hot_h is not null").select(columns)
    joined = met.where("hot_h is null").select("h", "doc_id", "row", "a", "b").join(first.where(~often).drop("times"), "h").select(columns)
    hits = at_once.unionAll(joined).where("doc_id > first_doc_id or (doc_id = first_doc_id and row > first_row)")
    parted = lambda c: [F.shiftright(c, 32).cast("int"), F.col(c).bitwiseAND(low).cast("int")]
    (pos, start), (last, end) = parted("a"), parted("b")
    elsewhere = hits.select("doc_id", "row", pos.alias("pos"), last.alias("last"), start.alias("start"), end.alias("end"), "first_doc_id")
    within = found.where("again").withColumn("first_doc_id", F.col("doc_id"))
    return elsewhere.unionAll(within.select(elsewhere.columns))


def repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal spans of sentences to remove: doc_id, row, first_sentence, last_sentence, start, end, first_doc_id (the least that has a part of it)."""
    runs = repeated_runs(docs, run, min_words).groupBy("doc_id", "row", "pos").agg(F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    order = W.partitionBy("doc_id", "row").orderBy("pos")
    fresh = F.coalesce(F.col("pos") > F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    runs = runs.withColumn("island", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = runs.groupBy("doc_id", "row", "island").agg(
        F.min("pos").alias("first_sentence"), F.max("last").alias("last_sentence"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id")
    )
    return joined.drop("island")


def without_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the text of all repeated spans taken out; all columns stay."""
    cuts = repeated_spans(docs, run, min_words).groupBy(F.col("doc_id").alias("cut_doc_id"), F.col("row").alias("cut_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut_spans"))
    rows = placed(docs.select(held(docs)).select("d", "d.doc_id", "d.text"))
    joined = rows.join(cuts, (F.col("doc_id") == F.col("cut_doc_id")) & (F.col("row") == F.col("cut_row")), "left")
    text, empty = F.col("d.text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("text"))
    left = F.aggregate("cut_spans", empty, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select(*[F.when(F.col("cut_spans").isNotNull(), left).otherwise(text).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
