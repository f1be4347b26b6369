"""Toxicity: a word classifier that is penalised when swapping identity terms changes its score.

Features are the distinct lower-cased words of a whole text, hashed. A logistic regression with
an L1 penalty learns from labelled documents; for every labelled sentence that names a group, a
counterfactual is made by replacing the group term with each other term of its family, and the
squared change of the score (before the sigmoid) is added to the loss. Terms thus can't earn
weight from how often they are insulted in the data, and neutral mentions stay neutral. Where no
labelled text names a group of ``families``, there are no counterfactuals and the penalty is idle:
what is left is the L1 logistic regression.

The fit uses at most ``max_rows`` labelled documents (those with the least hash of their id,
toxic and clean ones each up to half, so that a rare class isn't lost); counting and scoring use
all documents. Only rows whose ``crc32(doc_id) % 5`` isn't 0 teach. Scoring is one pass over the
texts with the learned weights, whose number is bounded by the hash space.

Defined cases: null and empty texts get the score of a text without known words; documents
without a label teach nothing; with no labels, or of one class only, every score is that class's
share (0.5 without any); repeated rows are scored each and teach once; a row without a doc_id is scored
and teaches nothing; of texts that share a labelled doc_id each teaches; repeated labels of a document count as
toxic if one of them is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table

#: Families of terms, in four languages, for groups of people that may stand in for each other.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrants", "natives"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("einwanderer", "einheimische"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("immigrés", "français"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "españoles"),
)
SPACE = 2**18
#: The weight with the least log loss on a quarter of the teaching rows of a sample (sf0.1), fitted to the rest.
L1 = 1e-4
MAX_ROWS = 20_000
#: Standard deviations from chance at which a word may get a weight.
SCREEN = 2.0
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def feature(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % SPACE


def features(words) -> np.ndarray:
    return np.unique(np.fromiter((feature(w) for w in words), np.int32)) if words else np.empty(0, np.int32)


def swaps(text: str, families: tuple[tuple[str, ...], ...]) -> list[tuple[int, int]]:
    """Pairs (term that stands, term put in its place) of a text's sentences, as features."""
    family = {t: f for f in families for t in f}
    out = set()
    for sentence in SENTENCE.findall(text):
        words = set(WORD.findall(sentence))
        for t in words & family.keys():
            # A term that the sentence names already adds nothing when it takes the other's place.
            out.update((feature(t), -1 if o in words else feature(o)) for o in family[t] if o != t)
    return sorted(out)


EXAMPLES = "toxic int, items array<int>, swaps array<array<int>>"


def examples(rows: DataFrame, families: tuple[tuple[str, ...], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").lower() for t in batch.column(1)]
            items = [features(set(WORD.findall(t))) for t in texts]
            pairs = [[list(p) for p in swaps(t, families)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], names=["toxic", "items", "swaps"])

    return rows.select("toxic", "text").mapInArrow(run, EXAMPLES)


def fit(items: list[np.ndarray], toxic: np.ndarray, pairs: np.ndarray, l1: float, fairness: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) by accelerated proximal gradient steps.

    Features seen in fewer than 3 documents are left out, and those whose count in toxic documents lies
    within SCREEN standard deviations of what chance gives. ``pairs``: rows of (term, other term).
    The gradient's Lipschitz constant is bounded feature by feature, so steps are diagonal.
    """
    share = float(toxic.mean()) if len(toxic) else 0.5
    none = np.empty(0, np.int32), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not 0 < share < 1:
        return none
    flat = np.concatenate(items)
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    df = np.bincount(flat, minlength=SPACE)
    times = np.bincount(flat, np.repeat(toxic, [len(x) for x in items]), minlength=SPACE)
    apart = np.abs(times - share * df) / np.sqrt(np.maximum(df, 1) * share * (1 - share))
    known = np.flatnonzero((df >= 3) & (apart >= SCREEN))
    if not len(known):
        return none
    place = np.full(SPACE + 1, -1)
    place[known] = np.arange(len(known))
    seen = place[flat] >= 0
    col, row = place[flat[seen]], row[seen]
    balance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) / len(toxic)
    # Counterfactuals: z changes by w[b] - w[a]; a term that isn't known counts as weight 0.
    a, b = (place[pairs[:, 0]], place[pairs[:, 1]]) if len(pairs) else (np.empty(0, int), np.empty(0, int))
    scale = fairness / max(1, len(pairs))
    w, c = np.zeros(len(known)), 0.0
    # Sizes of texts differ much; each feature's own curvature sets its step.
    length = np.bincount(row, minlength=len(items))
    curve = np.bincount(col, (balance * np.maximum(1, np.minimum(length, 50)))[row], minlength=len(known)) / 4
    curve += 4 * scale * (np.bincount(a[a >= 0], minlength=len(known)) + np.bincount(b[b >= 0], minlength=len(known)))
    step, t, y, yc = 1 / (curve + 1e-4), 1.0, w.copy(), c
    for _ in range(rounds):
        z = np.bincount(row, y[col], minlength=len(items)) + yc
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        grad = np.bincount(col, g[row], minlength=len(known))
        if len(pairs):
            d = 2 * scale * (np.where(b >= 0, y[b], 0) - np.where(a >= 0, y[a], 0))
            grad += np.bincount(b[b >= 0], d[b >= 0], minlength=len(known)) - np.bincount(a[a >= 0], d[a >= 0], minlength=len(known))
        new = y - step * grad
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
        new_c = yc - 4 * g.sum()
        if ((y - new) * (new - w) / step).sum() > 0:  # momentum points uphill: start it again
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, yc = new + (t - 1) / t2 * (new - w), new_c + (t - 1) / t2 * (new_c - c)
        w, c, t = new, new_c, t2
    kept = np.flatnonzero(w)
    return known[kept].astype(np.int32), w[kept], float(c)


def learned(rows: DataFrame, families: tuple[tuple[str, ...], ...], l1: float, fairness: float, rounds: int) -> dict[int, float]:
    """Weights by feature, the intercept at -1. ``rows`` (toxic, text) are bounded in number; one task fits them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, toxic, pairs = [], [], []
        for batch in batches:
            toxic += batch.column(0).to_pylist()
            items += [np.asarray(x, np.int32) for x in batch.column(1).to_pylist()]
            pairs += [p for x in batch.column(2).to_pylist() for p in x]
        at, w, c = fit(items, np.asarray(toxic, float), np.asarray(pairs, np.int64).reshape(-1, 2), l1, fairness, rounds) if items else (np.empty(0), np.empty(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([c, *w.tolist()], pa.float64())], names=["feature", "weight"])

    fitted = examples(rows, families).repartition(1).sortWithinPartitions("toxic", F.xxhash64("items")).mapInArrow(run, "feature int, weight double")
    return {r["feature"]: r["weight"] for r in fitted.collect()} or {-1: 0.0}


def scored(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, known = sent.value, {}
        start = weight[-1]
        for batch in batches:
            z = []
            for text in batch.column(1):
                if len(known) > 500_000:
                    known.clear()
                words = set(WORD.findall((text.as_py() or "").lower()))
                known.update([(w, weight.get(feature(w), 0.0)) for w in words if w not in known])
                # A feature counts once, as in training; words that share one are rare and carry weight only if it has any.
                z.append(start + sum({feature(w): x for w in words if (x := known[w])}.values()))
            score = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return plain(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, families=IDENTITY_TERMS, l1: float = L1, fairness: float = 1.0, rounds: int = 200) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    marked = plain(labels, ["doc_id", "toxic"]).where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Those with the least hashes, by class: a bounded list of ids, then their texts.
    order = F.xxhash64("doc_id")
    chosen = [marked.where(F.col("toxic") == x).orderBy(order, "doc_id").limit(max_rows // 2) for x in (0, 1)]
    # At most max_rows ids, so they may be broadcast.
    # Rows that repeat an id and a text teach once.
    rows = plain(docs, ["doc_id", "text"]).join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    rows = rows.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"]).select("toxic", "text")
    out = scored(docs, learned(rows, families, l1, fairness, rounds))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
