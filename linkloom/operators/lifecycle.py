"""Routing reads to statuses; review actions; the library and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.config import ADDED, MATCH, REVIEW, STATUS_LABELS, MatchConfig
from linkloom.functions.text import normalize_text, strip
from linkloom.operators.matching import Prepared, candidates_payload, match_reads


def route_reads(reads: DataFrame, catalog: DataFrame | Prepared, config: MatchConfig = MATCH, mode: str = "exact", scorer: str = "wratio") -> DataFrame:
    """Detections from reads (…, title, author, spine_color, readable, status): each gets exactly one status.

    What has the status of no book or of a repeat is discarded; what can't be read is unreadable or
    failed; the rest is matched. A flag ``not_a_book`` alone discards nothing: a spine that could be
    read is a book.
    """
    gone = F.col("status").isin("not_a_book", "duplicate")
    lost = ~F.coalesce("readable", F.lit(True)) | F.col("title").isNull() | (F.col("title") == "")
    fate = F.when(F.coalesce(gone, F.lit(False)), "discarded").when(lost, F.when(F.col("status") == "failed", "failed").otherwise("unreadable"))
    reads = reads.withColumn("fate", fate)
    matched = match_reads(reads.where("fate is null"), catalog, config, mode, scorer)
    matched = matched.withColumn("candidates", candidates_payload(F.col("candidates")))
    empty = F.array().cast(matched.schema["candidates"].dataType)
    rest = reads.where("fate is not null").withColumns({"candidates": empty, "confidence": F.lit(None).cast("double"), "margin": F.lit(None).cast("double"), "match_status": F.col("fate"), "chosen_book": F.lit(None).cast("long")})
    out = matched.withColumn("candidates", F.coalesce("candidates", empty)).unionByName(rest)
    return out.drop("status", "fate").withColumnRenamed("match_status", "status")


def auto_confirm(detections: DataFrame) -> DataFrame:
    """The library rows of automatic matches."""
    rows = detections.where("status = 'auto_added'")
    return rows.select(F.col("chosen_book").alias("book_id"), F.lit("").alias("custom_title"), F.lit("").alias("custom_author"), F.col("detection_id").alias("source_detection_id"), "created_at")


def checked_actions(actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``valid``: a confirmation names a book that exists or a title, a retry has a crop."""
    books = catalog.select(F.col("book_id").alias("known")).distinct()
    df = actions.join(books, F.col("book_id") == F.col("known"), "left")
    titled = strip(F.coalesce("custom_title", F.lit(""))) != ""
    confirm = F.col("known").isNotNull() | (F.col("book_id").isNull() & titled)
    valid = F.when(F.col("action") == "confirm", confirm).when(F.col("action") == "retry", F.col("has_crop")).otherwise(F.col("action") == "discard")
    return df.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("known")


def confirmed_entries(checked: DataFrame) -> DataFrame:
    """A library row for each valid confirmation, each time anew; a book leaves the custom fields blank."""
    own = lambda c: F.when(F.col("book_id").isNotNull(), "").otherwise(strip(F.coalesce(c, F.lit(""))))
    rows = checked.where("valid and action = 'confirm'")
    return rows.select("book_id", own("custom_title").alias("custom_title"), own("custom_author").alias("custom_author"), F.col("detection_id").alias("source_detection_id"), F.col("ts").alias("created_at"))


#: What a retry replaces in a detection, besides its status and its book.
MATCHED = ("title", "author", "spine_color", "readable", "not_a_book", "candidates", "confidence", "margin")


def apply_review_actions(detections: DataFrame, checked: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """Detections after their valid actions, in the order of (ts, action_id).

    The latest action names the status. The book is that of the latest confirmation or retry: a discard
    keeps it. With ``retries`` (see ``retried``) a retry replaces all that was read and matched; one that
    hasn't been read yet counts for nothing.
    """
    when = F.struct("ts", "action_id")
    counts = checked.where(F.col("valid") & F.col("action").isin("confirm", "discard"))
    if retries is not None:
        counts = counts.unionByName(checked.where("valid and action = 'retry'").join(retries.select("detection_id"), "detection_id", "left_semi"))
    chose = F.when(F.col("action") != "discard", when)
    last = counts.groupBy("detection_id").agg(F.max_by("action", when).alias("last"), F.max_by(F.struct("action", "book_id"), chose).alias("choice"), F.max(F.col("action") == "retry").alias("retried"))
    out = detections.join(last, "detection_id", "left")
    again = F.lit(None).cast(f"struct<status:string,chosen_book:{dict(detections.dtypes)['chosen_book']}>")
    replaced = {}
    if retries is not None:
        fields = [c for c in MATCHED if c in detections.columns and c in retries.columns]
        out = out.join(retries.select("detection_id", F.struct("status", "chosen_book", *fields).alias("again")), "detection_id", "left")
        again = F.when(F.coalesce("retried", F.lit(False)), F.col("again"))
        replaced = {c: F.when(again.isNotNull(), again[c]).otherwise(F.col(c)) for c in fields}
    status = F.when(F.col("last") == "confirm", "confirmed").when(F.col("last") == "discard", "discarded").when(F.col("last") == "retry", F.coalesce(again["status"], F.col("status")))
    book = F.when(F.col("choice.action") == "confirm", F.col("choice.book_id")).when((F.col("choice.action") == "retry") & again.isNotNull(), again["chosen_book"])
    book = F.when(F.col("choice").isNull(), F.col("chosen_book")).otherwise(book)
    return out.withColumns(replaced | {"status": F.coalesce(status, F.col("status")), "chosen_book": book}).drop("last", "choice", "retried", "again")


def retried(detections: DataFrame, checked: DataFrame, reads: DataFrame, catalog: DataFrame | Prepared, **how) -> DataFrame:
    """New matches of the detections that are read again; ``reads`` holds one read for each detection_id.

    ``apply_review_actions`` puts them into the detections, ``auto_confirm`` adds the library rows of those that match.
    """
    again = checked.where("valid and action = 'retry'").select("detection_id").distinct()
    kept = detections.select("detection_id", "scan_id", "created_at").join(again, "detection_id", "left_semi")
    return route_reads(kept.join(reads, "detection_id"), catalog, **how)


def edit_library(library: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits``: (entry_id, kind edit or delete, custom_title, custom_author, ts, action_id). A null field isn't edited; of each field the latest edit counts, of equal times that with the larger action_id. A deletion is final."""
    gone = edits.where("kind = 'delete'").select("entry_id").distinct()
    fields = ("custom_title", "custom_author")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "action_id"))).alias(f"new_{c}")
    last = edits.where("kind = 'edit'").groupBy("entry_id").agg(*map(latest, fields))
    kept = library.join(gone, "entry_id", "left_anti").join(last, "entry_id", "left")
    return kept.withColumns({c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in fields}).drop(*[f"new_{c}" for c in fields])


def scan_status(scans: DataFrame, boxes: DataFrame, reads: DataFrame) -> DataFrame:
    """done or failed, whether the whole photo was read instead, and whether that gave nothing."""
    count = lambda df, name: df.groupBy("scan_id").agg(F.count(F.lit(1)).alias(name))
    out = scans.join(count(boxes, "n_boxes"), "scan_id", "left").join(count(reads, "n_reads"), "scan_id", "left").fillna(0, ["n_boxes", "n_reads"])
    fallback = F.col("n_boxes") == 0
    return out.select("scan_id", F.when(F.col("error"), "failed").otherwise("done").alias("status"), fallback.alias("used_fallback"), (fallback & (F.col("n_reads") == 0) & ~F.col("error")).alias("empty_result"))


def review_queue(detections: DataFrame) -> DataFrame:
    """What waits for a person, scan by scan."""
    return detections.where(F.col("status").isin(*REVIEW)).orderBy("scan_id", "slot")


def status_bucket(c: Column) -> Column:
    return F.when(c.isin(*ADDED), "added").when(c.isin(*REVIEW), "review")


def status_label(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])[c]


def display(custom: Column, own: Column) -> Column:
    """A custom value if there is one, else the book's, else ''."""
    return F.coalesce(F.nullif(custom, F.lit("")), own, F.lit(""))


def meta_line(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def library_view(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries with the title and author to show, newest first."""
    books = catalog.select("book_id", F.col("title").alias("book_title"), F.col("author").alias("book_author"), "year", "series", "spine_color")
    out = library.join(books, "book_id", "left")
    out = out.select("entry_id", "book_id", display(F.col("custom_title"), F.col("book_title")).alias("display_title"), display(F.col("custom_author"), F.col("book_author")).alias("display_author"), meta_line(F.col("year"), F.col("series"), F.col("spine_color")).alias("meta"), "created_at")
    return out.orderBy(F.desc("created_at"), F.desc("entry_id"))


def orphaned_entries(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries that show nothing any more: no custom title and no book in the catalog."""
    bare = library.where("coalesce(custom_title, '') = ''")
    return bare.join(catalog.select("book_id"), "book_id", "left_anti")


def snapshot_library(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries that carry their title and author themselves, so a reload of the catalog can't blank them."""
    books = catalog.select("book_id", F.col("title").alias("t"), F.col("author").alias("a"))
    out = library.join(books, "book_id", "left")
    return out.withColumns({"custom_title": display(F.col("custom_title"), F.col("t")), "custom_author": display(F.col("custom_author"), F.col("a"))}).drop("t", "a")


def omnibus_volumes(catalog: DataFrame) -> DataFrame:
    """(book_id, volume, is_present): the volumes of each omnibus, and whether they have a row of their own."""
    volumes = catalog.where("is_omnibus").select("book_id", F.explode("contained_titles").alias("volume"))
    own = catalog.select(normalize_text(F.col("title")).alias("t")).distinct()
    found = volumes.withColumn("v", normalize_text(F.col("volume"))).join(own, F.col("v") == F.col("t"), "left")
    return found.select("book_id", "volume", F.col("t").isNotNull().alias("is_present"))
