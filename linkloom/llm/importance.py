"""Importance resampling towards a target distribution, by external sort-count.

Features of a text are all runs of 1 to ``n`` words, each hashed into one of a fixed number of
buckets. One pass over the texts writes their buckets as packed 16-bit streams, with the offset
at which each document begins; everything later reads these streams, a third of the texts' size.
To count, each task sorts its streams, run by run, turns them into (bucket, length of the run) and
adds these up; Spark adds the tasks' counts. A bucket's gain is the log ratio of its frequencies in
the target and in all documents; the gains, one number a bucket, go to the tasks, where they are
gathered along the streams and summed from offset to offset.

A document's score is its weight plus a noise that a hash of its id decides, so that the highest
scores are a draw without replacement by weight, and reruns agree. Ranks come from a range
partitioning by (score, id): a row's rank is the number of rows in earlier ranges plus its place in
its own.

Defined cases: a null, empty or wordless text has no features, weight 0 and is never drawn; a
missing doc_id counts as an empty one in the noise and comes before all others among ties; rows
that repeat are units of their own; an empty table gives an empty result; an empty target has no
counts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table, written
from linkloom.llm.words import NO_LETTERS, gaps, word_blocks

BUCKETS, RUN, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Features of a stream, a longer document's apart.
STREAM = 1 << 20
#: Words whose buckets a task remembers.
KNOWN = 1 << 20

STREAMS = "doc_ids array<long>, n_words array<long>, offsets array<long>, size long, buckets binary"


class Buckets(dict):
    """Word -> bucket, computed when missing; forgets all when full."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n
        return found


def streams(texts: DataFrame, run: int, buckets: int) -> DataFrame:
    """Bucket streams of (doc_id, text): each row holds some documents' features and where they begin."""
    assert buckets <= 1 << 16
    separators = gaps(NO_LETTERS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(buckets).__getitem__
        ids, sizes, offsets, out = [], [], [], array("H")

        def row() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, sizes, offsets)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([len(out)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["doc_ids", "n_words", "offsets", "size", "buckets"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                offsets.append(len(out))
                n, tail = 0, []
                for words in word_blocks(text.as_py(), separators):
                    n += len(words)
                    out.extend(map(bucket, words))
                    for k in range(2, run + 1):
                        # Runs that begin in the block before need its last k - 1 words.
                        both = tail[len(tail) - k + 1 :] + words if len(tail) >= k else tail + words
                        out.extend(bucket(b" ".join(both[i : i + k])) for i in range(len(both) - k + 1))
                    tail = (tail + words)[-(run - 1) :] if run > 1 else []
                sizes.append(n)
                if len(out) >= STREAM or len(ids) >= STREAM:
                    yield row()
                    ids, sizes, offsets, out = [], [], [], array("H")
        if ids:
            yield row()

    return plain(texts, ["doc_id", "text"]).mapInArrow(work, STREAMS)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stream, sorted, and how often each occurs."""
    s = np.sort(stream)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def counted(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all streams; at most ``buckets`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                values, lengths = runs(np.frombuffer(stream.as_py(), np.uint16))
                counts[values] += lengths
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """A whole number a bucket: 1000 times the log ratio of target to raw, both smoothed by one a bucket."""
    s, t = (dict(x.collect()) for x in (raw, target))  # one row a bucket at most
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)]


def gathered(found: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document of the streams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.asarray(gain, np.int64)
        for batch in batches:
            for ids, sizes, offsets, stream in zip(*(batch.column(c) for c in ("doc_ids", "n_words", "offsets", "buckets")), strict=True):
                starts, stream = offsets.values.to_numpy(), np.frombuffer(stream.as_py(), np.uint16)
                lengths = np.diff(np.append(starts, len(stream)))
                weight, own = np.zeros(len(starts), np.int64), lengths > 0
                if own.any():  # reduceat can't say that nothing lies between two offsets
                    weight[own] = np.add.reduceat(of[stream], starts[own])
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(lengths, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the order of columns (a minus: falling), without gathering them."""
    keys = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_first() for o in order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Row numbers begin at 0 in each partition, in the lower 33 bits.
    at = F.monotonically_increasing_id()
    placed = written(sorted_.select("*", F.spark_partition_id().alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranked")
    before, n = {}, 0
    for part, rows_of in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        before[part] = n
        n += rows_of
    first = rows.sparkSession.createDataFrame(list(before.items()), "part int, first long")
    return placed.join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("at") + 1).drop("part", "at", "first")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank; ``target`` has the column ``text``."""
    found = written(streams(docs, run, buckets), "streams")
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("`text`").alias("text")), run, buckets)
    gain = gains(counted(found, buckets), counted(aim, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(gathered(found, gain).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    unfit = scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(fit), "-score", "doc_id").select(*columns, rank).unionAll(unfit)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The CRC of each different word goes byte by byte over a table of 256.
OP12_SQL = r"""
with crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))) as crcs),
docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
aims as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
each as (select row, unnest(words) as word from docs),
counted as (select word, sum(s) as s, sum(t) as t from (select word, 1 as s, 0 as t from each union all select word, 0, 1 from aims) group by word),
bytes as (select word, s, t, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint) as b from counted),
hashed as (select word, s, t, (xor(list_reduce(list_prepend(4294967295, b), lambda r, x: xor(r >> 8, crcs[xor(r & 255, x) + 1])), 4294967295) % 10000)::int as bucket from bytes, crcs),
buckets as (select bucket, sum(s) as s, sum(t) as t from hashed group by bucket),
gains as (select bucket, floor(1000 * ln(((t + 1) * ((select sum(s) from buckets) + 10000))::double / ((s + 1) * ((select sum(t) from buckets) + 10000))))::bigint as gain from buckets),
weights as (select row, sum(gain)::bigint as weight from each join hashed using (word) join gains using (bucket) group by row),
scored as (select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score from docs left join weights using (row)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end::bigint as rank from placed"""
