"""Near-duplicate documents: MinHash with banding, signature verification, full confirmation, components.

A document is the set of its distinct runs of ``words`` lower-cased (A-Z) words. Two documents
are linked when ``100 * |A and B| >= similarity * |A or B|``. The steps:

1. One scan turns each text into a 128-bit hash of its set, its universal hash minima and its
   band keys; only these are written.
2. Documents with the same set form a class, stood for by its least id, so exact copies never
   meet one another.
3. In each bucket (equal band key) every member is paired with the bucket's least member only.
   Pairs survive by size, then by how many minima agree (a bound that a true link misses with a
   chance of about 1e-9), then by the exact intersection of full sets. Links give components.
4. Buckets in which several components are left are gone through in full, so no link between
   components is lost. (Links within a component can't change anything.) Buckets with the same
   members count once. Blocks of bounded size meet, first by minima alone: a member goes on if
   enough minima agree with a member of another component. What is left meets again by sets: the
   exact intersections of all of a block are products of incidence matrices, and a block returns
   one link for each two components that have one, so no pairs are ever emitted.

With 24 bands of 4 minima, a link at 80 % misses all buckets with a chance of 3e-6, one at 90 %
with 3e-11.

Defined cases: null, empty or blank texts have no set (``n_shingles`` 0) and are linked with
nothing; a text with fewer words than a run is one run; repeated rows belong to one class; rows
that share a doc_id are one document, which has the links of all its texts; rows without a doc_id
can't be named, hence not linked: they are kept unless a document with a doc_id has the same set; an
empty table gives an empty result; other columns are ignored, whatever their names
(``without_near_copies`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.shared import held, known_id, plain, table, written

BANDS, ROWS = 24, 4
#: Members and shingles of a block of a bucket; two blocks meet in a task.
BLOCK_ROWS, BLOCK_ITEMS = 1024, 2_000_000
#: Standard deviations below the threshold at which agreeing minima still count as similar.
DEVIATIONS = 6


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that their high bits depend on all of them (a public-domain finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of words. ``bytes`` lower-cases A-Z and splits at the six ASCII spaces only."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of ``n`` universal hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, (n, 1), np.uint64) | np.uint64(1), rng.integers(0, 2**64, (n, 1), np.uint64)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least value of each hash function over the items, as unsigned 32-bit numbers."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(items), block):
        least = np.minimum(least, (a * items[at : at + block] + b).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, minima array<int>, bands array<long>, text_hash long"


def sketches(docs: DataFrame, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest, xxh128_digest

        a, b = coefficients(bands * rows, seed)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                items = shingles(text.as_py(), words)
                if not len(items):
                    out.append((doc_id, 0, 0, 0, None, None, text_hash))
                    continue
                least = minima(items, a, b)
                keys = [xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) - 2**63 for i in range(bands)]
                whole = np.frombuffer(xxh128_digest(items.tobytes()), np.int64)
                out.append((doc_id, len(items), int(whole[0]), int(whole[1]), least.view(np.int32), keys, text_hash))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_shingles", "s1", "s2", "minima", "bands", "text_hash"])

    return plain(docs, ["doc_id", "text"]).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Rows come sorted by ``b``, so its set is made once for a run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, theirs = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, theirs = b, shingles(y.as_py(), words)
                own = shingles(x.as_py(), words)
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                keep.append(100 * both >= similarity * (len(own) + len(theirs) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "u long, v long")


def agreeing(similarity: int, count: int) -> int:
    """How many of ``count`` minima of a linked pair agree, but for a chance of about 1e-9, at least."""
    p = similarity / 100
    return max(1, math.floor(count * p - DEVIATIONS * math.sqrt(count * p * (1 - p))))


def similar_by_minima(pairs: DataFrame, sketch: DataFrame, similarity: int, count: int) -> DataFrame:
    """Drops pairs of which too few minima agree, or whose sizes alone rule a link out."""
    least = agreeing(similarity, count)
    side = lambda c: sketch.select(F.col("id").alias(c), F.col("minima").alias(f"minima_{c}"), F.col("n").alias(f"n_{c}"))
    agree = F.size(F.filter(F.zip_with("minima_a", "minima_b", lambda x, y: x == y), lambda same: same))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity
    return pairs.join(side("a"), "a").join(side("b"), "b").where(close & (agree >= least)).select("a", "b")


def close_by_minima(similarity: int, count: int):
    """The members of a block that may be linked to one of another component, judged by minima and sizes."""
    least = agreeing(similarity, count)

    def run(group: pa.Table) -> pa.Table:
        parts, size = group["component"].to_numpy(), group["n"].to_numpy()
        least_values = group["minima"].combine_chunks().flatten().to_numpy().reshape(len(parts), count)
        alive = np.zeros(len(parts), bool)
        for at in range(0, len(parts), 64):
            rows = slice(at, at + 64)
            agree = (least_values[rows, None, :] == least_values[None, :, :]).sum(axis=2)
            few, many = np.minimum(size[rows, None], size[None, :]), np.maximum(size[rows, None], size[None, :])
            alive[rows] = ((agree >= least) & (100 * few >= similarity * many) & (parts[rows, None] != parts[None, :])).any(axis=1)
        return group.select(["key", "id", "component", "n"]).filter(pa.array(alive))

    return run


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Each member of a bucket with every pair (i, j) of the bucket's blocks that its own block belongs to."""
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "blocks", "other")


def links_between(words: int, similarity: int):
    """One link for each two components of a block that have one, from the exact intersections of all its sets."""

    def run(group: pa.Table) -> pa.Table:
        ids, parts = group["id"].to_numpy(), group["component"].to_numpy()
        sets = [shingles(t.as_py(), words) for t in group["text"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        row = np.repeat(np.arange(len(sets)), size)
        _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[item] > 1  # items of one text only are in no intersection
        row, item = row[shared], item[shared]
        order = np.argsort(item, kind="stable")
        row, item = row[order], np.unique(item[order], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(item.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(item, [at, at + 2048])
            holds = np.zeros((len(sets), 2048), np.float32)
            holds[row[a:b], item[a:b] - at] = 1
            both += holds @ holds.T
        linked = 100 * both >= similarity * (size[:, None] + size[None, :] - both)
        u, v = np.nonzero(linked & (parts[:, None] < parts[None, :]))
        _, one = np.unique(np.stack([parts[u], parts[v]]), axis=1, return_index=True)
        return pa.table({"u": ids[u[one]], "v": ids[v[one]]})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (is it the least of its component?)."""
    sketch = written(sketches(docs, words, bands, rows, seed), "sketches")
    filled = sketch.where("n_shingles > 0")
    classes = written(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    keyed = filled.join(classes.withColumnRenamed("id", "doc_id"), ["s1", "s2", "doc_id"])
    keyed = keyed.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    # Buckets that hold two sets or more, and their members; everything later looks at these alone.
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    members = written(keyed.select("id", "key").join(shared.select("key", "first"), "key").dropDuplicates(["key", "id"]), "members")
    near = members.select("id").distinct()
    # A row for each text of an id; rows that repeat whole are one.
    reps = written(filled.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "minima", "s1", "s2").join(near, "id", "left_semi").dropDuplicates(["id", "s1", "s2"]).drop("s1", "s2"), "candidates")
    texts = written(plain(docs, ["doc_id", "text"]).withColumnRenamed("doc_id", "id").join(near, "id", "left_semi").withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "t"]).drop("t"), "texts")
    # Several sets of one id: their classes belong together.
    several = filled.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("doc_id is not null and x <> y").select("doc_id")
    own = filled.join(several, "doc_id").select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).where("id <> doc_id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct()

    stars = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    links = written(confirmed(similar_by_minima(stars, reps, similarity, bands * rows), texts, words, similarity).unionAll(own).distinct(), "links")
    found = components(links)

    named = members.select("key", "id").join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    per_key = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows"), *[F.expr(f"{f}(xxhash64(id, {i}))").alias(f"m{i}") for i, f in enumerate(("bit_xor", "bit_xor", "bit_or"))])
    # Buckets whose members hash alike have the same members, and one of them will do.
    mixed_keys = per_key.where("x <> y").groupBy("rows", "m0", "m1", "m2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    left = written(named.join(mixed_keys, "key").select("key", "id", "component", "blocks"), "left")
    by_minima = in_blocks(left, F.col("blocks")).join(reps, "id").select("key", "i", "j", "id", "component", "n", "minima")
    alive = by_minima.groupBy("key", "i", "j").applyInArrow(close_by_minima(similarity, bands * rows), "key long, id long, component long, n long")
    alive = written(alive.groupBy("key", "id", "component").agg(F.max("n").alias("n")), "alive")
    sizes = alive.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    by_sets = in_blocks(alive.join(sizes, "key"), F.col("blocks")).join(texts, "id").select("key", "i", "j", "id", "component", "text")
    more = by_sets.groupBy("key", "i", "j").applyInArrow(links_between(words, similarity), "u long, v long")
    found = components(written(links.unionAll(more.distinct()), "links"))

    of_class = classes.join(found, F.col("id") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    out = sketch.join(of_class, ["s1", "s2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def without_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of each component, that with the least doc_id (of several with it, that with the least hash of its text); all columns stay.

    Texts without a set are no copies and stay, but for rows that repeat doc_id and text.
    """
    kept = near_duplicates(docs, **how).where("kept")
    once = kept.groupBy(known_id(F.col("doc_id")).alias("kept_id"), F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("text_hash")).alias("k")).agg(F.min("text_hash").alias("kept_hash"))
    rows = docs.select(held(docs), known_id(F.col("doc_id")).alias("id"), F.xxhash64(F.col("text")).alias("text_hash"))
    same = (F.col("id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    nth = F.row_number().over(W.partitionBy("id", "text_hash").orderBy(F.xxhash64("d")))
    return rows.join(once.select("kept_id", "kept_hash").distinct(), same, "left_semi").withColumn("nth", nth).where("nth = 1").select("d.*")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("text_hash")


OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
), sizes as (select doc_id, len(s)::bigint as n from sets),
items as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * shared >= 80 * (x.n + y.n - shared)),
two as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as c from sizes union select t.b, r.c from reach r join two t on t.a = r.doc_id),
least as (select doc_id, min(c) as component_id from reach group by 1)
select s.doc_id, s.n as n_shingles, l.component_id, s.doc_id = l.component_id as kept from sizes s join least l using (doc_id)
"""
