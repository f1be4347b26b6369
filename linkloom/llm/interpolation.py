"""Scores of a language model by deleted interpolation of n-gram estimates.

The probability of a token is a mixture of maximum-likelihood estimates: of the n-gram, of ever
shorter ones, of the token alone, and a uniform one over the vocabulary and one unknown token. The
mixture weights depend on how often the token's context was seen, in buckets of powers of two. They are
learned by expectation-maximisation on tokens of training documents whose own counts are taken out
(deleted) of the estimates; the scores then use the counts of all training documents.

How it runs. A pass over the texts packs tokens into *chunks*: the hashes of the chunk's different
tokens, and its tokens as places among these. A chunk holds training documents, deleted ones or
others, never a mix. Each chunk then asks for the counts of its different n-grams, once each, however
often they occur: the n-grams' hashes, sorted, go as packed runs to ranges of hashes, where the
counts of all chunks are added up, and the sums return in the order asked. An n-gram of whatever
frequency comes once from each chunk, so no range is hot, and the number of ranges follows the
number of tokens. Counts meet the chunk's tokens again by a join on the chunk, where documents are
scored. The weights, a row for each of some fifty buckets, are all that goes through the driver.

N-grams are known by 64-bit hashes. Two that collide would share their counts; among a billion the
chance that any two do is about 3 %.

Defined cases: a null or empty text is the end token alone; rows without a doc_id are training
rows (their id hashes as an empty text); rows that repeat are counted each; a long text is spread
over as many chunks as it needs; without training documents every token has the uniform
probability; without deleted ones all estimates weigh alike; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.minhash import mixed
from linkloom.llm.shared import plain, table, written
from linkloom.llm.words import BLANKS, gaps, word_blocks

#: Words of an n-gram, at most.
ORDER = 2
#: Of so many documents that teach, one is deleted.
DELETED = 16
#: Tokens of a chunk; n-grams of a range.
CHUNK, RANGE = 1 << 20, 1 << 21
#: Buckets of context frequencies: 0, 1, 2-3, 4-7, ...
FREQUENCIES = 48
ROUNDS, ENOUGH = 40, 1e-5
#: What the weights of all buckets together count for in each, in tokens.
PRIOR = 10.0
TRAIN, TAKEN_OUT, OTHER = 0, 1, 2
#: No word holds a blank.
END, BEGIN = b" end", b" begin"

CHUNKS = "chunk long, kind int, n_tokens long, pieces binary, doc_ids array<long>, words binary, tokens binary"


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, those of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros((0, 0), np.uint8)
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind)


class Chunk:
    """Documents, or parts of long ones, whose tokens are numbered in the order in which they first occur.

    A piece is (number of its row, tokens of context, tokens that count). The context is what came before
    in the document, or begin marks.
    """

    def __init__(self, kind: int) -> None:
        self.kind, self.ids, self.pieces, self.n = kind, [], [], 0
        self.place: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id, row: int, context: list[bytes], words: list[bytes]) -> None:
        place = self.place
        numbers = [place.setdefault(w, len(place)) for w in (*context, *words)]
        self.tokens.append(np.asarray(numbers, np.uint32))
        self.ids.append(doc_id)
        self.pieces.append((row, len(context), len(words)))
        self.n += len(words)

    def batch(self, number: int) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        words = np.fromiter(map(xxh3_64_intdigest, self.place), np.uint64, len(self.place))
        tokens = np.concatenate(self.tokens)
        values = [[number], [self.kind], [self.n], [packed(np.asarray(self.pieces, np.int64).reshape(-1))], [self.ids], [packed(words)], [packed(tokens)]]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["chunk", "kind", "n_tokens", "pieces", "doc_ids", "words", "tokens"])


def chunks(docs: DataFrame, order: int, folds: int, held_out: int, deleted: int, size: int) -> DataFrame:
    blanks = gaps(BLANKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, row = TaskContext.get().partitionId(), 0, 0
        open_: dict[int, Chunk] = {}

        def put(kind: int, *piece) -> Iterator[pa.RecordBatch]:
            nonlocal made
            chunk = open_.setdefault(kind, Chunk(kind))
            chunk.add(*piece)
            if chunk.n >= size:
                yield open_.pop(kind).batch(task << 32 | made)
                made += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                kind = OTHER if number % folds == held_out else TAKEN_OUT if number // folds % deleted == 0 else TRAIN
                context, before, row = [BEGIN] * (order - 1), None, row + 1
                for words in word_blocks(text.as_py(), blanks):
                    if before:
                        yield from put(kind, doc_id, task << 32 | row, context, before)
                        context = (context + before)[len(before) :]
                    before = words
                yield from put(kind, doc_id, task << 32 | row, context, [*(before or []), END])
        for chunk in open_.values():
            yield chunk.batch(task << 32 | made)
            made += 1

    return plain(docs, ["doc_id", "text"]).mapInArrow(work, CHUNKS)


def grams(words: np.ndarray, tokens: np.ndarray, pieces: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a chunk's counted tokens, of each length the n-grams that end with them, then of each length
    the contexts before them: the different hashes, sorted, and each token's place among these."""
    begins = np.cumsum(pieces[:, 1] + pieces[:, 2]) - pieces[:, 2]
    counted = np.ones(len(tokens), bool)
    for back in range(1, order):
        counted[begins - back] = False
    at, w = np.flatnonzero(counted), np.int64(len(words))
    spread = mixed(words)

    def lengths(last: int, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        code, h = tokens[at - last].astype(np.int64), mixed(spread + np.uint64(last))
        out = [(h, code)]
        for k in range(last + 1, longest):
            distinct, code = np.unique(code * w + tokens[at - k], return_inverse=True)
            h = mixed(h[distinct // w] * np.uint64(0x9E3779B97F4A7C15) + spread[distinct % w])
            out.append((h, code))
        return out

    found = []
    for h, code in lengths(0, order) + lengths(1, order) * (order > 1):
        by_hash = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[by_hash] = np.arange(len(h))
        found.append((h[by_hash], place[code]))
    return found


def of_chunk(row: dict, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    pieces = unpacked(row["pieces"], np.int64).reshape(-1, 3)
    return pieces, grams(unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.uint32), pieces, order)


def asked(found: DataFrame, order: int, bits: int) -> DataFrame:
    """Per chunk, kind of n-gram and range of hashes: the hashes, and how often the chunk has each if it teaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]  # one chunk at a time
                for gram, (keys, at) in enumerate(of_chunk(row, order)[1]):
                    times = np.bincount(at, minlength=len(keys)).astype(np.uint32)
                    ranges = np.arange(1 << bits, dtype=np.uint64)
                    cuts = np.append(np.searchsorted(keys, ranges << np.uint64(64 - bits)) if bits else [0], len(keys))
                    own = [r for r in range(1 << bits) if cuts[r] < cuts[r + 1]]
                    parts = [keys[cuts[r] : cuts[r + 1]] for r in own]
                    steps = [packed(np.diff(x, prepend=np.uint64(0))) for x in parts]
                    sent = [packed(times[cuts[r] : cuts[r + 1]]) if row["kind"] != OTHER else None for r in own]
                    n = len(own)
                    values = [own, [row["chunk"]] * n, [row["kind"]] * n, [gram] * n, steps, sent]
                    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["range", "chunk", "kind", "gram", "keys", "times"])

    return found.select("chunk", "kind", "pieces", "words", "tokens").mapInArrow(work, "range int, chunk long, kind int, gram int, keys binary, times binary")


COUNTS = "chunk long, gram int, range int, counts binary, kept binary, n long, v long, n_kept long, v_kept long"


def answered(questions: DataFrame) -> DataFrame:
    """The counts of a range's hashes in all training chunks, and in those that aren't deleted, in each chunk's order.

    A row without a chunk has the number of tokens and of different ones in the range, for both.
    """

    def work(asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = asked.to_pylist()
        for gram in sorted({r["gram"] for r in rows}):
            own = [r for r in rows if r["gram"] == gram]
            keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in own]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.cumsum([len(k) for k in keys])
            total, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            for r, k, end in zip(own, keys, ends, strict=True):
                if r["times"] is not None:  # a chunk asks for a hash once, so no place repeats
                    times = unpacked(r["times"], np.uint32)
                    total[place[end - len(k) : end]] += times
                    if r["kind"] == TRAIN:
                        kept[place[end - len(k) : end]] += times
            for r, k, end in zip(own, keys, ends, strict=True):
                at = place[end - len(k) : end]
                out.append((r["chunk"], gram, r["range"], packed(total[at]), packed(kept[at]) if r["kind"] == TAKEN_OUT else None, None, None, None, None))
            if gram == 0:
                out.append((None, gram, rows[0]["range"], None, None, int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        names = [x.split()[0] for x in COUNTS.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return questions.groupBy("range").applyInArrow(work, COUNTS)


def met(chunk: pa.Table, counts: pa.Table, order: int, which: str) -> tuple[dict, np.ndarray, list[np.ndarray]]:
    """A chunk, its pieces, and for each counted token the counts of its n-grams, then of its contexts."""
    row = chunk.to_pylist()[0]
    pieces, found = of_chunk(row, order)
    parts = sorted(counts.select(["gram", "range", which]).to_pylist(), key=lambda r: (r["gram"], r["range"]))
    of = [np.concatenate([unpacked(r[which], np.int64) for r in parts if r["gram"] == gram]) for gram in range(len(found))]
    return row, pieces, [c[at] for c, (_, at) in zip(of, found, strict=True)]


def estimates(counts: list[np.ndarray], order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket (how long its longest known context is, and how frequent), and its estimates, shortest first."""
    seen, frequency = np.zeros(len(counts[0]), np.int64), np.zeros(len(counts[0]), np.int64)
    p = np.zeros((order, len(counts[0])))
    p[0] = counts[0] / max(1, n)
    for k in range(1, order):
        context = counts[order + k - 1]
        known = context > 0
        seen[known], frequency[known] = k, context[known]
        p[k] = np.where(known, counts[k] / np.maximum(1, context), 0.0)
    return seen * FREQUENCIES + np.where(seen > 0, np.frexp(frequency)[1], 0), p


def events(found: DataFrame, counts: DataFrame, order: int, n: int) -> DataFrame:
    """(bucket, p1, p2, ...) of each deleted token, by the counts of what isn't deleted."""
    names = [f"p{k + 1}" for k in range(order)]

    def work(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, p = estimates(met(chunk, answers, order, "kept")[2], order, n)
        return pa.Table.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.float64()) for x in p)], names=["bucket", *names])

    left, right = found.where(F.col("kind") == TAKEN_OUT), counts.where("kept is not null")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(work, ", ".join(["bucket int", *(f"{x} double" for x in names)]))


def learned(held: DataFrame, order: int, v: int) -> np.ndarray:
    """Weights of the estimates by bucket, the uniform one first. Each round is one aggregation to a row per bucket."""
    spark, p = held.sparkSession, [F.lit(1 / (v + 1)), *(F.col(f"p{k + 1}") for k in range(order))]
    weights, before = defaults(order), -math.inf
    for _ in range(ROUNDS):
        now = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], ", ".join(["b int", *(f"w{k} double" for k in range(order + 1))]))
        parts = [F.col(f"w{k}") * p[k] for k in range(order + 1)]
        whole = sum(parts[1:], parts[0])
        sums = held.join(F.broadcast(now), F.col("bucket") == F.col("b")).groupBy("bucket").agg(F.sum(F.log(whole)).alias("fit"), F.count(F.lit(1)).alias("n"), *[F.sum(x / whole).alias(f"s{k}") for k, x in enumerate(parts)])
        rows = sums.collect()
        if not rows:
            return weights
        share = np.zeros_like(weights)
        for r in rows:
            share[r["bucket"]] = [r[f"s{k}"] for k in range(order + 1)]
        overall = defaults(order) * share.sum(axis=0) / max(share.sum(), 1e-300) + 1e-9 * defaults(order)
        share += PRIOR * overall / overall.sum(axis=1, keepdims=True)
        weights = share / share.sum(axis=1, keepdims=True)
        fit = math.fsum(r["fit"] for r in rows) / sum(r["n"] for r in rows)
        if fit - before < ENOUGH:
            break
        before = fit
    return weights


def defaults(order: int) -> np.ndarray:
    """Equal weights of the estimates that a bucket can have."""
    can = np.arange(order + 1)[None, :] <= 1 + np.arange(order * FREQUENCIES)[:, None] // FREQUENCIES
    return can / can.sum(axis=1, keepdims=True)


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = ORDER, deleted: int = DELETED, size: int = CHUNK, range_size: int = RANGE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = written(chunks(docs, order, folds, held_out, deleted, size), "chunks")
    tokens = found.agg(F.sum("n_tokens")).first()[0] or 0
    bits = math.ceil(math.log2(max(1, tokens * order / range_size)))
    counts = written(answered(asked(found, order, bits)), "counts")
    n, v, n_kept, v_kept = (x or 0 for x in counts.agg(*(F.sum(c) for c in ("n", "v", "n_kept", "v_kept"))).first())
    weights = learned(written(events(found, counts, order, n_kept), "events"), order, v_kept)
    if not n:
        weights = np.eye(1, order + 1).repeat(len(weights), axis=0)

    def work(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, pieces, of = met(chunk, answers, order, "counts")
        bucket, p = estimates(of, order, n)
        w = weights[bucket]
        mixture = w[:, 0] / (v + 1) + sum(w[:, k + 1] * p[k] for k in range(order))
        starts = np.cumsum(pieces[:, 2]) - pieces[:, 2]
        summed = [np.add.reduceat(x, starts) for x in ((of[0] > 0).astype(np.int64), np.log10((of[0] + 1) / (n + v + 1)), np.log10(mixture))]
        values = [pieces[:, 0], row["doc_ids"], np.full(len(pieces), row["kind"] == OTHER), pieces[:, 2], *summed]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    pieces = found.groupBy("chunk").cogroup(counts.where("chunk is not null").select("chunk", "gram", "range", "counts").groupBy("chunk")).applyInArrow(work, SCORES)
    whole = pieces.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op13_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
