"""Audits of the catalog; reports on scans, matches, latency and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import ADDED, REVIEW, STATUS_LABELS
from linkloom.functions.text import normalize_author, normalize_hex, normalize_text


def scan_summary(detections: DataFrame) -> DataFrame:
    """Per scan: detections added, for review, and of each status."""
    s = F.col("status")
    return detections.groupBy("scan_id").agg(F.count_if(s.isin(*ADDED)).alias("added"), F.count_if(s.isin(*REVIEW)).alias("review"), *[F.count_if(s == x).alias(x) for x in STATUS_LABELS])


def match_buckets(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def read_quality(reads: DataFrame) -> DataFrame:
    """Per scan: crops, good reads, repeats and the share of good ones."""
    s = F.col("status")
    return reads.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "duplicate").alias("duplicates"), F.avg((s == "ok").cast("double")).alias("ok_share"))


def stage_latency(timings: DataFrame, exact: bool = True) -> DataFrame:
    """The median of each stage, exact or approximate. ``timings``: scan_id and a map from stage to milliseconds."""
    rows = timings.select(F.explode("timings").alias("stage", "ms"))
    middle = F.median("ms") if exact else F.percentile_approx("ms", 0.5, 10_000)
    return rows.groupBy("stage").agg(middle.cast("double").alias("median_ms"), F.count(F.lit(1)).alias("n"))


def auto_rate(detections: DataFrame) -> DataFrame:
    """Detections of each status and their share of all."""
    counts = detections.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("status", "n", (F.col("n") / F.col("all")).alias("share"))


def scan_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Per model: scans, cost per scan and per 1,000. ``rates``: dollars per million tokens in and out."""
    cost = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6
    return usage.join(rates, "model").groupBy("model").agg(F.count(F.lit(1)).alias("scans"), F.avg(cost).alias("cost_per_scan"), (F.avg(cost) * 1000).alias("cost_per_1000"))


def batch_saving(usage: DataFrame) -> DataFrame:
    """Tokens with one prompt per scan and with one per crop, and the share that is saved."""
    batched, single = F.col("prompt_tokens") + F.col("image_tokens"), F.col("prompt_tokens") * F.col("n_crops") + F.col("image_tokens")
    out = usage.groupBy("n_crops").agg(F.sum(batched).alias("batched"), F.sum(single).alias("single"))
    return out.withColumn("saving", 1 - F.col("batched") / F.col("single"))


def cost_projection(cost: DataFrame, scans_per_day: tuple[int, ...] = (100, 1_000, 10_000)) -> DataFrame:
    """Monthly cost of each model at daily volumes; calls in batches cost half."""
    day = F.explode(F.array(*map(F.lit, scans_per_day))).alias("scans_per_day")
    out = cost.select("model", "cost_per_scan", day).withColumn("monthly", F.col("cost_per_scan") * F.col("scans_per_day") * 30)
    return out.withColumn("monthly_batch", F.col("monthly") / 2).drop("cost_per_scan")


def catalog_profile(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("alt_titles") > 0).alias("with_alt"), F.count_if(F.col("series") != "").alias("with_series"),
        F.count_if(F.col("year").isNotNull()).alias("with_year"), F.count_if(F.col("spine_color") != "").alias("with_color"), F.count_if("is_omnibus").alias("omnibus"),
    )


def keyed(catalog: DataFrame) -> DataFrame:
    name = normalize_author(F.col("author"))
    return catalog.withColumn("t", normalize_text(F.col("title"))).withColumn("name", name)


def audit_shared_titles(catalog: DataFrame) -> DataFrame:
    """Titles that several known authors have."""
    found = keyed(catalog).groupBy(F.col("t").alias("norm_title")).agg(F.count_distinct("name").alias("n_authors"), F.count(F.lit(1)).alias("n_rows"))
    return found.where("n_authors > 1")


def audit_editions(catalog: DataFrame) -> DataFrame:
    """Books that stand in the catalog more than once, and the years."""
    found = keyed(catalog).groupBy(F.col("t").alias("norm_title"), F.col("name.surname").alias("surname"), F.array_join("name.initials", " ").alias("initials"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(F.sort_array(F.collect_set("year")), lambda y: y.cast("string")), ",").alias("years")).where("n_rows > 1")


def audit_alt_titles(catalog: DataFrame) -> DataFrame:
    """(book_id, alt_title, other_id): alternates that are another row's title."""
    alts = catalog.select("book_id", F.explode("alt_titles").alias("alt_title")).withColumn("k", normalize_text(F.col("alt_title")))
    titles = catalog.select(F.col("book_id").alias("other_id"), normalize_text(F.col("title")).alias("k"))
    return alts.join(titles, "k").where("book_id <> other_id").select("book_id", "alt_title", "other_id")


def audit_substring_titles(catalog: DataFrame) -> DataFrame:
    """(title_in, title_of): distinct titles all of whose words another title has. Joined on the rarest word, so no word's list meets itself."""
    titles = catalog.select(normalize_text(F.col("title")).alias("t")).where("t <> ''").distinct().withColumn("ws", F.array_distinct(F.split("t", " ")))
    words = titles.select("t", "ws", F.explode("ws").alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, "w").groupBy("t").agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.first("ws").alias("own"))
    found = rarest.withColumnRenamed("t", "title_in").join(words.select("w", F.col("t").alias("title_of"), "ws"), "w")
    return found.where((F.size(F.array_except("own", "ws")) == 0) & (F.size("own") < F.size("ws"))).select("title_in", "title_of")


def audit_author_variants(catalog: DataFrame) -> DataFrame:
    """Names that are written in several ways."""
    found = keyed(catalog).where("name is not null").groupBy(F.col("name.surname").alias("surname"), F.array_join("name.initials", " ").alias("initials"))
    return found.agg(F.count_distinct("author").alias("n_forms"), F.array_join(F.sort_array(F.collect_set("author")), "; ").alias("forms")).where("n_forms > 1")


def check_hexes(catalog: DataFrame) -> DataFrame:
    """Rows whose stored colour code isn't in its normal form."""
    return catalog.where(F.col("spine_hex") != normalize_hex(F.col("spine_hex"))).select("book_id", "spine_hex")


def catalog_coverage(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """(title, problem) of expected books that are missing or differ in author, colour or code."""
    have = catalog.select(normalize_text(F.col("title")).alias("k"), F.col("author").alias("a"), F.col("spine_color").alias("c"), F.col("spine_hex").alias("h"))
    found = expected.withColumn("k", normalize_text(F.col("title"))).join(have, "k", "left")
    ok = (F.col("author") == F.col("a")) & (F.coalesce("spine_color", F.lit("")) == F.col("c")) & (F.coalesce("spine_hex", F.lit("")) == F.col("h"))
    best = found.groupBy("title").agg(F.max(F.col("a").isNotNull()).alias("there"), F.max(F.coalesce(ok, F.lit(False))).alias("right"))
    return best.where("not right").select("title", F.when(F.col("there"), "differs").otherwise("missing").alias("problem"))
