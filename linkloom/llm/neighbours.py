"""Nearest neighbours by inner product: a block matrix join with int8 tiles and error bounds.

Each vector is quantised once: to int8, and what that leaves over to int8 again. Candidates and
queries are dealt by a hash into blocks of bounded size. Each pair of a query block and a candidate
block is one tile, and one task's work: the tile of int8 products bounds every inner product from
both sides, and pairs whose upper bound reaches the k-th largest lower bound of their query get
bounds some 250 times closer from the second bytes. Those that reach the k-th lower bound again, few
more than k a query, leave the tile as (id, bounds); heaps merge these, first over groups of tiles,
then over all. Only what is left then is joined with the original vectors and computed in doubles.

Tiles are sent two bytes a component, originals only to surviving pairs. The bounds are rigorous,
so the result is exact, ties included: for ``x = u + e`` and ``y = v + f``,
``|x.y - u.v| <= |x|.|f| + |e|.|v|``, from exact norms. Of equal vectors only the ``k + 1`` with
the least ids can be among anyone's nearest; the others are no candidates, so a vector that a third
of all rows share doesn't swell the lists.

Vectors that are null, empty, zero, of another length than the most frequent one, or hold null
or non-finite components take no part. Rows that repeat a vec_id count once, with their least
vector. Without candidates there are no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table, written

#: Rows of a candidate block and of a query block.
BLOCK, QUERY_BLOCK = 4096, 2048
#: Tiles whose results one heap merges first.
GROUP = 64
#: Pairs whose second bounds are computed at a time.
PAIRS = 65_536


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, each id once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    vectors = plain(vectors, ["vec_id", "embedding"]).where("vec_id is not null and size(embedding) > 0").select("vec_id", v.alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def quantised(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """int8 rows for rows whose components are at most 127 scales."""
    return np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)


#: Of a vector: both bytes of each component, the first scale, its norm, and for each depth the norms of what the bytes stand for and of the rest.
CODES = "vec_id long, q binary, r binary, scale double, norm double, stood1 double, rest1 double, stood2 double, rest2 double"
NUMBERS = ["scale", "norm", "stood1", "rest1", "stood2", "rest2"]


def codes(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            scale = np.abs(x).max(axis=1) / 127
            q = quantised(x, scale)
            rest = x - q * scale[:, None]
            r = quantised(rest, scale / 254)
            last = rest - r * (scale / 254)[:, None]
            length = lambda v: np.linalg.norm(v, axis=1)
            with np.errstate(over="ignore"):
                numbers = (scale, length(x), length(x - rest), length(rest), length(x - last), length(last))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v.tobytes() for v in m], pa.binary()) for m in (q, r)), *map(pa.array, numbers)], names=["vec_id", "q", "r", *NUMBERS])

    return vectors.select("vec_id", "embedding").mapInArrow(run, CODES)


class Side:
    """One side of a tile, as arrays."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = rows["vec_id"].to_numpy()
        self.q, self.r = (np.frombuffer(b"".join(rows[c].to_pylist()), np.int8).reshape(len(self.ids), -1) for c in ("q", "r"))
        self.scale, self.norm, self.stood1, self.rest1, self.stood2, self.rest2 = (rows[c].to_numpy() for c in NUMBERS)

    def both(self, rows: np.ndarray) -> np.ndarray:
        """What both bytes stand for."""
        return (self.q[rows] + self.r[rows] / 254.0) * self.scale[rows, None]


def between(near: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds; numbers too large for doubles bound nothing."""
    bound = bound * (1 + 1e-9) + np.abs(near) * 1e-12 + 1e-300
    known = np.isfinite(near) & np.isfinite(bound)
    return np.where(known, near - bound, -np.inf), np.where(known, near + bound, np.inf)


def near_rows(x: Side, part: slice, y: Side, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the part of x, row of y) whose upper bound reaches the k-th lower bound of their query."""
    # Products of int8 rows are whole numbers below 2**24 for up to 1,000 components, so single precision holds them exactly.
    kind = np.float32 if x.q.shape[1] <= 1000 else np.float64
    near = (x.q[part].astype(kind) @ y.q.astype(kind).T).astype(np.float64) * x.scale[part, None] * y.scale[None, :]
    low, up = between(near, x.norm[part, None] * y.rest1[None, :] + x.rest1[part, None] * y.stood1[None, :])
    own, n = x.ids[part, None] == y.ids[None, :], len(y.ids)
    low = np.where(own, -np.inf, low)
    floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
    return np.nonzero((up >= floor[:, None]) & ~own)


FOUND = "query_id long, part int, ids array<long>, low array<double>, up array<double>"
FOUND_TYPES = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())), ("up", pa.list_(pa.float64()))])


def best(ids: list, low: list, up: list, k: int) -> tuple[list, list, list]:
    """What can still be among the k best, by a heap of the lower bounds that never holds more than k."""
    floor = heapq.nlargest(k, low)[-1] if len(low) > k else -math.inf
    kept = [i for i, u in enumerate(up) if u >= floor]
    return [ids[i] for i in kept], [low[i] for i in kept], [up[i] for i in kept]


def tile(k: int, chunk: int = 256):
    """The candidates of one block that can be among the k best, for each query of another: one row a query. Queries go through in chunks."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND_TYPES.empty_table()
        x, y, out = Side(left), Side(right.rename_columns([c.removeprefix("c_") for c in right.column_names])), []
        for at in range(0, len(x.ids), chunk):
            rows, cols = near_rows(x, slice(at, at + chunk), y, k)
            rows, low, up = rows + at, np.empty(len(rows)), np.empty(len(rows))
            for i in range(0, len(rows), PAIRS):
                a, b = rows[i : i + PAIRS], cols[i : i + PAIRS]
                with np.errstate(over="ignore", invalid="ignore"):
                    low[i : i + PAIRS], up[i : i + PAIRS] = between(np.einsum("ij,ij->i", x.both(a), y.both(b)), x.norm[a] * y.rest2[b] + x.rest2[a] * y.stood2[b])
            for q in range(at, min(at + chunk, len(x.ids))):
                own = slice(*np.searchsorted(rows, [q, q + 1]))
                out.append((x.ids[q], key[1].as_py() // GROUP, *best(y.ids[cols[own]].tolist(), low[own].tolist(), up[own].tolist(), k)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND_TYPES, strict=True)], schema=FOUND_TYPES)

    return run


def merged(k: int):
    """What of a query's lists can be among its k best."""

    def run(group: pa.Table) -> pa.Table:
        ids, low, up = (group[c].combine_chunks().flatten().to_pylist() for c in ("ids", "low", "up"))
        return pa.table([group["query_id"][:1], pa.array([0], pa.int32()), *(pa.array([c], f.type) for c, f in zip(best(ids, low, up, k), list(FOUND_TYPES)[2:], strict=True))], schema=FOUND_TYPES)

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of all vectors for each vector that fulfils ``queries``: query_id, rank, vec_id, score."""
    vectors = written(usable(vectors), "vectors")
    size = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    vectors = vectors.where(F.size("embedding") == (size["n"] if size else 0))
    alike = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    candidates = written(codes(vectors.withColumn("alike", alike).where(F.col("alike") <= k + 1)), "codes")
    asked = written(codes(vectors.where(queries)), "asked")
    dealt = lambda df, rows: max(1, math.ceil(df.count() / rows))
    blocks, query_blocks = dealt(candidates, block), dealt(asked, query_block)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", own(query_blocks).alias("qb"), every(blocks).alias("vb"))
    right = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns], own(blocks).alias("vb"), every(query_blocks).alias("qb"))
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(tile(k), FOUND)
    if blocks > GROUP:
        found = found.groupBy("query_id", "part").applyInArrow(merged(k), FOUND)
    found = found.groupBy("query_id").applyInArrow(merged(k), FOUND)
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"))
    x, y = (vectors.select(F.col("vec_id").alias(i), F.col("embedding").alias(v)) for i, v in (("query_id", "x"), ("vec_id", "y")))
    # Added in the order of the components.
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)
    scores = pairs.join(x, "query_id").join(y, "vec_id").select("query_id", "vec_id", product.alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 20
"""
