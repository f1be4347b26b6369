"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits and runs of other characters; n-grams are single tokens
and pairs, hashed into a fixed number of buckets. Two multinomials over the buckets are counted:
one over the trusted documents, one over all. A document's verdict is its sum of log ratios
divided by its number of n-grams, held against a fixed threshold: every document is decided, and
always alike. A bucket's ratio is ``ln((t + s) / (e + s))`` with ``t`` its count in trusted
texts, ``e`` the count expected there from all texts, and ``s`` a smoothing count that draws rare
buckets to 0, so new words speak neither for nor against a text.

All on built-in functions. The counts come from one aggregation with partial sums over a fixed
number of keys; the model (one row per bucket) is broadcast, its size being fixed; scores are
summed within the task that read the text, and only sums are shuffled.

Defined cases: null, empty and blank texts have no words and fail the base rules; rows that repeat
whole get one verdict each; rows without labels are only counted in the raw corpus; without
trusted documents no ratio speaks (verdict by the base rules alone); rows without a doc_id are
judged like all others and are never trusted; rows that share a doc_id are judged each by its own
text; an empty table gives an empty result; other columns are ignored (``quality``) or kept
(``passing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.shared import WORD, WORD_GAP, held, known_id, plain, table, words_of, written

BUCKETS = 2**16
SMOOTHING = 20.0
THRESHOLD = -0.25
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
#: Ids of trusted documents up to which they are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    d = plain(docs, ["doc_id", "text"]).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("lines", lines)
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("hashes", windows)
    # Most texts repeat no window: only the others pay for a sort that brings equal windows together.
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed))
    beside = lambda x, i: x["h"].eqNullSafe(F.get("sorted", i)["h"])
    twice = F.filter("sorted", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    d = d.withColumn("twice", twice)
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n_words, repeated = F.size("words").cast("long"), F.coalesce(F.size(covered), F.lit(0)).cast("long")
    d = d.select(
        "doc_id",
        "text",
        n_words.alias("n_words"),
        F.length(F.regexp_replace(text, WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice").isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with a row for each n-gram and its ``bucket``, and ``at``: 0 on a document's first row only."""
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    keep = [c for c in docs.columns if c != "text"]
    d = docs.select(*keep, tokens.alias("tokens"))
    pairs = F.arrays_zip(F.col("tokens").alias("a"), F.when(F.size("tokens") > 1, F.slice("tokens", 2, F.size("tokens"))).otherwise(F.array().cast("array<string>")).alias("b"))
    d = d.select(*keep, F.posexplode_outer(pairs).alias("at", "g"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    both = F.array(F.when(F.col("g.a").isNotNull(), bucket(F.col("g.a"))), F.when(F.col("g.b").isNotNull(), bucket(F.col("g.a"), F.lit(2), F.col("g.b"))))
    return d.select(*keep, F.coalesce("at", F.lit(0)).alias("at"), F.posexplode(both).alias("kind", "bucket")).select(*keep, (F.col("at") + F.col("kind")).alias("at"), "bucket")


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, ratio): the model, at most one row per bucket. ``trusted`` holds doc_ids."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).distinct()
    ids = written(ids, "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = plain(docs, ["doc_id", "text"]).join(side, F.col("doc_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().cast("long").alias("own"))
    counts = grams(marked, buckets).where("bucket is not null").groupBy("bucket").agg(F.sum("own").alias("t"), F.count(F.lit(1)).alias("n"))
    counts = written(counts, "counts")
    t, n = counts.agg(F.sum("t"), F.sum("n")).first()
    expected = F.col("n") * F.lit((t or 0) / (n or 1))
    return counts.select("bucket", F.log((F.col("t") + smoothing) / (expected + smoothing)).alias("ratio"))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, n_grams, mean_ratio, kept; and row_hash of the text."""
    model = ratios(docs, trusted, buckets, smoothing)
    base = base_counts(docs).withColumn("row_hash", F.xxhash64("text"))
    keys, counts = ["doc_id", "row_hash"], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    each = grams(base, buckets).join(F.broadcast(model.withColumnRenamed("bucket", "model_bucket")), F.col("bucket") == F.col("model_bucket"), "left")
    # The base counts aren't keys: a later filter on them must not move below the aggregation, where it would count again.
    total = each.groupBy(*keys).agg(*[F.first(c).alias(c) for c in counts], F.sum("ratio").alias("ratios"), F.count("bucket").alias("n_grams"), F.sum((F.col("at") == 0).cast("long")).alias("rows"))
    # What the rows that repeat whole have together is shared out among them again.
    total = total.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    mean = F.coalesce(F.col("ratios") / F.nullif(F.col("n_grams"), F.lit(0)), F.lit(0.0))
    total = total.select(*keys, *counts, (F.col("n_grams") / F.col("rows")).cast("long").alias("n_grams"), mean.alias("mean_ratio"))
    return total.withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= threshold))


def passing(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with all their columns."""
    kept = quality(docs, trusted, **how).where("kept").select(known_id(F.col("doc_id")).alias("kept_id"), F.col("row_hash").alias("kept_hash")).distinct()
    rows = docs.select(held(docs))
    return rows.join(kept, (known_id(F.col("d.doc_id")) == F.col("kept_id")) & (F.xxhash64("d.text") == F.col("kept_hash")), "left_semi").select("d.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return plain(labels, ["doc_id", "quality"]).where("quality = 1").select("doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return found.drop("row_hash")
