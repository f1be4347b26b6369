"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, ``target / source size``.
Its whole part is given to all; the fraction is an inclusion probability. The cube method's
flight moves these probabilities through the null-space of two balancing constraints, the words
and the number of documents, until at most two of a block are left between 0 and 1. Blocks of a
source fly independently; what they leave over is dealt into new blocks and flies again, until
each source has one block. There a dozen documents wait on the ground; the landing sets these and
what the flight leaves to the choice, of all, that comes nearest to the expected words. A
source's words thus end up at its target to within a small part of a document.

All random choices come from a seed, the source and the block, and rows are sorted first, so
reruns and recomputed tasks agree. A block holds a bounded number of rows whatever the source's
size, and only (id, source, size) is ever shuffled.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share ``share`` of all
words; a target stops at ``most`` times its source's words and the excess goes to the others by
weight until none is above.

Defined cases: null text has size 0; a null source is a source; repeated rows are units of their
own; sources without words have target 0; an empty table gives an empty result; columns that the
operator doesn't know are ignored (``mix``) or kept (``mixed``), whatever their names.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.shared import WORD, held, plain, table, written

#: The weights of sources, in order, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a block.
BLOCK = 2000
#: Documents of a source that wait for the landing, besides the two that its flight leaves at most.
LANDING = 12
NEAR = 1e-9


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of each source; one row a source.

    The level at which ``sum(min(weight * level, most * size))`` meets the wanted sum is found by
    rounds of one aggregation each: sources above it are set to their limit, until none is.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * level > limit
        fixed, free = sources.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        now = (share * total - fixed) / free if free else level
        if now <= level * (1 + 1e-12):
            break
        level = now
    return sources.select("source", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def flight(p: list[float], size: list[float], rng: random.Random) -> list[int]:
    """Moves probabilities in place, keeping their sum and the expected size; the places still between 0 and 1."""
    todo, open_ = iter(range(len(p))), []
    while True:
        while len(open_) < 3 and (i := next(todo, None)) is not None:
            if NEAR < p[i] < 1 - NEAR:
                open_.append(i)
        if len(open_) < 3:
            equal = len(open_) == 2 and size[open_[0]] == size[open_[1]]
            if not equal:
                return open_
            u = (1.0, -1.0)
        else:
            a, b, c = (size[i] for i in open_)
            u = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        step(p, open_, u, rng)
        open_ = [i for i in open_ if NEAR < p[i] < 1 - NEAR]


def step(p: list[float], at: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    """One move along ``u``, to either end with the chance that keeps every probability's mean."""
    up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(at, u, strict=True) if x)
    down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(at, u, strict=True) if x)
    move = up if rng.random() * (up + down) < down else -down
    for i, x in zip(at, u, strict=True):
        p[i] = min(1.0, max(0.0, p[i] + move * x))
        if p[i] < NEAR or p[i] > 1 - NEAR:
            p[i] = float(round(p[i]))


def landing(p: list[float], size: list[float], at: list[int]) -> None:
    """Sets the few that are left to 0 or 1 such that words, then documents, come nearest to what is expected."""
    if not at:
        return
    chance, words = np.array([p[i] for i in at]), np.array([size[i] for i in at])
    choices = (np.arange(2 ** len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(choices @ words - chance @ words) + 0.01 * words.mean() * np.abs(choices.sum(axis=1) - chance.sum())
    for i, x in zip(at, choices[int(off.argmin())], strict=True):
        p[i] = float(x)


def flown(last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "nth", "p"], na_position="first").reset_index(drop=True)
        rng = random.Random(f"{seed} {key[0]} {key[1]} {last}")
        order = list(range(len(pdf)))
        rng.shuffle(order)
        p, size = [pdf["p"].iat[i] for i in order], [float(pdf["size"].iat[i]) for i in order]
        flying = max(0, len(p) - LANDING) if last else len(p)
        first = p[:flying]
        left = flight(first, size, rng)
        p[:flying] = first
        if last:
            landing(p, size, [*left, *range(flying, len(p))])
        back = pd.Series(p, index=order)
        return pdf.assign(p=back.reindex(range(len(pdf))).to_numpy())

    return run


#: Ids travel as text: pandas has no whole numbers with nulls. ``nth`` tells rows apart that agree in the rest.
UNIT = "doc_id string, source string, size long, nth long, whole int, p double"
#: Rows that are written out of a count at a time.
SPREAD = 4096


def told_apart(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``nth`` (from 1) among rows that agree in all columns: they are counted and written out again."""
    counts = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {SPREAD}"))))
    return parts.withColumn("nth", F.explode(F.sequence(F.col("part") * SPREAD + 1, F.least("n", (F.col("part") + 1) * SPREAD)))).drop("n", "part")


def block_of(rows: Column, turn: int, block: int) -> Column:
    """The block of a row of a source that has so many; rows that agree in all but ``nth`` are spread too."""
    return F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(turn)), F.ceil(rows / block)).cast("long")


def mix_sizes(sizes: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Adds source_size, target and copies to (doc_id, source, size)."""
    sizes = written(told_apart(sizes.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size")), "sizes")
    plan = targets(sizes, share, most)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sizes.join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = units.select("doc_id", "source", "size", "nth", F.floor(e + NEAR).cast("int").alias("whole"), F.greatest(F.lit(0.0), e - F.floor(e + NEAR)).alias("p"))
    done, turn = [units.where(F.col("p") <= NEAR)], 0
    units = units.where(F.col("p") > NEAR)
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most_rows = counts.agg(F.max("n")).first()[0] or 0
        last = most_rows <= block
        dealt = units.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = dealt.withColumn("block", F.lit(0).cast("long") if last else block_of(F.col("n"), turn, block)).drop("n")
        flew = written(dealt.groupBy("source", "block").applyInPandas(flown(last, seed + turn), UNIT + ", block long").drop("block"), "flown")
        if last:
            done.append(flew)
            break
        open_ = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
        done.append(flew.where(~open_))
        units, turn = flew.where(open_), turn + 1
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionAll(more)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", (F.col("whole") + F.round("p").cast("int")).alias("copies"))
    return chosen.join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def sized(docs: DataFrame) -> DataFrame:
    return plain(docs, ["doc_id", "source", "text"]).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, copies counted)."""
    return mix_sizes(sized(docs), **how).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Copies are given to (doc_id, source, size): rows that agree in these take equal parts, the first of them the rest.
    """
    chosen = mix_sizes(sized(docs), **how).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("all_rows"))
    own = docs.select(held(docs), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("own_size"))
    key = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("own_size") == F.col("c.size"))
    joined = own.join(chosen.where("all_copies > 0").alias("c"), key)
    once = joined.where("all_rows = 1").select("d", F.col("all_copies").alias("times"))
    nth = F.row_number().over(W.partitionBy("d.doc_id", "d.source", "own_size").orderBy(F.xxhash64("d.text")))
    again = joined.where("all_rows > 1").select("d", (F.floor(F.col("all_copies") / F.col("all_rows")) + (nth <= F.col("all_copies") % F.col("all_rows")).cast("long")).alias("times"))
    taken = once.unionAll(again).where("times > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy_number")).select("d.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
