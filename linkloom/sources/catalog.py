"""Reading, replacing and updating the catalog; reading model responses; writing detections."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import clean_color, normalize_author, normalize_hex, normalize_text, parse_flag, parse_year, split_pipe_list, strip
from linkloom.tables import written

OPTIONAL = ("alt_titles", "year", "series", "is_omnibus", "contained_titles", "spine_color", "spine_hex")
RESPONSE = "scan_id long, n_crops int, raw_text string, call_failed boolean, repair_text string, repair_failed boolean"


def read_catalog(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """A catalog from CSV with a header: title and author, other columns where there are any; ids in row order unless given."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    if missing := {"title", "author"} - set(raw.columns):
        raise ValueError(f"the catalog has no column {sorted(missing)}")
    if "book_id" not in raw.columns:
        # The id that Spark gives a row is its partition's number, times 2 ** 33, and its place there: files in the order of
        # their names, lines in theirs.
        raw = numbered(raw.withColumn("file", F.col("_metadata.file_path")).withColumn("start", F.col("_metadata.file_block_start")).withColumn("line", F.monotonically_increasing_id()), ["file", "start", "line"], 0).drop("file", "start", "line")
    return typed_catalog(raw, on_error)


def numbered(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """Adds book_id from ``start + 1`` on, in an order that tells all rows apart. No task sees more than its own range.

    Rows are parted by ranges of the order; a row's number is the count of rows in earlier parts and
    its rank within its own. Both read one written table, so parts don't change between them.
    """
    parted = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parted")
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # A row a partition: as many as Spark has shuffle partitions.
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    ranked = parted.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return ranked.join(F.broadcast(before), "part").withColumn("book_id", F.lit(start) + F.col("before") + F.col("rank")).drop("part", "before", "rank")


def typed_catalog(raw: DataFrame, on_error: str = "raise") -> DataFrame:
    c = {n: F.coalesce(F.col(n), F.lit("")) if n in raw.columns else F.lit("") for n in ("title", "author", *OPTIONAL)}
    return raw.select(
        F.col("book_id").cast("long").alias("book_id"),
        strip(c["title"]).alias("title"),
        strip(c["author"]).alias("author"),
        split_pipe_list(c["alt_titles"]).alias("alt_titles"),
        parse_year(c["year"], on_error).alias("year"),
        strip(c["series"]).alias("series"),
        parse_flag(c["is_omnibus"]).alias("is_omnibus"),
        split_pipe_list(c["contained_titles"]).alias("contained_titles"),
        clean_color(c["spine_color"]).alias("spine_color"),
        normalize_hex(c["spine_hex"]).alias("spine_hex"),
    )


#: Where a catalog keeps its versions, and the list of them: a reader of the folder itself finds neither.
VERSIONS, PUBLISHED = "_versions", "_published"


def replace_catalog(df: DataFrame, path: str) -> str:
    """Writes a whole new version beside the older ones, then makes it the current one; returns its folder.

    What makes it current is one small file that appears at once and whole: a row with the version's
    number. Until then readers see the version before; those that read an older one go on.
    """
    path, spark = path.rstrip("/"), df.sparkSession
    version = f"{path}/{VERSIONS}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    number = (published(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, version.rsplit("/", 1)[-1])], PUBLICATION).coalesce(1).write.mode("append").json(f"{path}/{PUBLISHED}")
    return version


PUBLICATION = "number long, version string"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The versions of a catalog, by number; of two of the same number, written side by side, the greater name counts."""
    try:
        return spark.read.schema(PUBLICATION).json(f"{path.rstrip('/')}/{PUBLISHED}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLICATION)


def current_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog as the latest replacement left it."""
    last = published(spark, path).agg(F.max(F.struct("number", "version")).alias("last")).first()["last"]
    if last is None:
        raise FileNotFoundError(f"no catalog was written to {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{VERSIONS}/{last['version']}")


def business_key() -> Column:
    name = normalize_author(F.col("author"))
    return F.struct(normalize_text(F.col("title")).alias("t"), name["surname"].alias("s"), name["initials"].alias("i"), F.col("year").alias("y"))


def upsert_catalog(current: DataFrame, incoming: DataFrame, last: int | None = None, twice: str = "raise") -> DataFrame:
    """Incoming rows replace those of the same title, author and year, keep their ids, and new ones get ids after the largest (``last``, if ``current`` isn't the whole).

    A key that comes twice in ``incoming`` is an error. With ``twice='join'``, as for books that nothing in
    their key tells apart, each of its rows meets each stored row of the key, or gets an id of its own.
    """
    columns = [c for c in current.columns if c != "book_id"]
    old, new = current.withColumn("key", business_key()), incoming.select(*columns).withColumn("key", business_key())
    if twice == "raise" and new.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two incoming rows have the same title, author and year")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.key").eqNullSafe(F.col("n.key")), "full_outer").select(F.col("o.book_id").alias("book_id"), F.coalesce("n.key", "o.key").alias("key"), *[F.when(F.col("n.key").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])
    if last is None:
        last = current.agg(F.coalesce(F.max("book_id"), F.lit(0))).first()[0]
    fresh = numbered(both.where("book_id is null").drop("book_id"), ["key", *columns], last).select(both.columns)
    return both.where("book_id is not null").unionByName(fresh).select("book_id", *columns)


def write_responses(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Responses as compressed JSON lines, which hold some eight times the bytes of the lines that they were made of.

    Readers deal files out by their bytes and don't cut compressed ones, so a file has ``rows`` lines at most: many files make many tasks.
    """
    df.write.option("maxRecordsPerFile", rows).json(path, compression="lz4")


def read_responses(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(RESPONSE).format(kind).load(path)


#: Buckets of a stored catalog.
BUCKETS = 64


def in_buckets(df: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64(*[F.col("key")[f] for f in ("t", "s", "i", "y")])
    return df.withColumn("key", business_key()).withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).drop("key")


def store_buckets(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A catalog with its ids as a new table in buckets of its key."""
    in_buckets(df, buckets).write.partitionBy("bucket").parquet(path)


def upsert_buckets(spark: SparkSession, path: str, incoming: DataFrame, buckets: int = BUCKETS, twice: str = "raise") -> list[int]:
    """``upsert_catalog`` into a stored catalog of which only the touched buckets are read and written; returns these.

    Rows lie in buckets of their key. The files of other buckets stay as they are; of them only the
    ids are looked at, for the largest. An empty or missing ``path`` is an empty catalog.
    """
    incoming = written(in_buckets(incoming.drop("book_id"), buckets), "incoming")
    touched = sorted(r[0] for r in incoming.select("bucket").distinct().collect())  # a row a bucket at most
    stored = stored_rows(spark, path)
    if stored is None:
        stored = incoming.withColumn("book_id", F.lit(None).cast("long")).where("false")
    last = stored.agg(F.max("book_id")).first()[0] or 0
    columns = ["book_id", *[c for c in stored.columns if c not in ("book_id", "bucket")]]
    merged = upsert_catalog(stored.where(F.col("bucket").isin(touched)).select(columns), incoming, last, twice)
    # Read before it is overwritten.
    written(in_buckets(merged, buckets), "upserted").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_detections(df: DataFrame, path: str) -> None:
    """Detections with their nested candidates, by the date of the scan. What is there already isn't written again, so a batch may be repeated."""
    df = df.withColumn("scan_date", F.to_date("created_at")).dropDuplicates(["detection_id"])
    there = stored_rows(df.sparkSession, path)
    if there is not None:
        first, last = df.agg(F.min("scan_date"), F.max("scan_date")).first()
        same_days = there.where(F.col("scan_date").between(F.lit(first), F.lit(last)) | F.col("scan_date").isNull())
        df = df.join(written(same_days.select("detection_id"), "written-ids"), "detection_id", "left_anti").select(df.columns)
    df.write.mode("append").partitionBy("scan_date").parquet(path)


def scan_documents(scans: DataFrame, detections: DataFrame) -> DataFrame:
    """One JSON document per scan with its detections in order; a scan without any has an empty list, a field without a value a null."""
    fields = [c for c in detections.columns if c != "scan_id"]
    listed = detections.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("detections"))
    empty = F.array().cast(listed.schema["detections"].dataType)
    out = scans.join(listed, "scan_id", "left").withColumn("detections", F.coalesce("detections", empty))
    return out.select("scan_id", F.size("detections").alias("n_detections"), F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("document"))
