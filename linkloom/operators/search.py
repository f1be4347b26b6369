"""Search of titles and authors by what they hold, through a stored table of letter groups.

Every group of one, two and three letters of a book's title and author has a row for the book. A
query is answered from the group of its own that the fewest books have, and these books are looked at;
one of up to three letters is a group itself. Groups lie in parts by a hash, sorted within, so a search
reads the parts and the row groups of the groups it needs. The table is made once for many searches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import strip
from linkloom.tables import written

#: Letters of a group, at most; parts of the table; groups up to which a search names them to the scan.
LETTERS, PARTS, NAMED = 3, 64, 1000


@dataclass(frozen=True)
class SearchIndex:
    """Groups of a catalog: (part, gram, book_id), how many books have each (gram, n), and the strings (book_id, t, a).

    ``stored``: in parts, of which a search reads its own; else the groups of one search only.
    """

    postings: DataFrame
    counts: DataFrame
    strings: DataFrame
    stored: bool = True


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def groups(s: Column, least: int) -> Column:
    """All groups of a string; of ``least`` letters at least."""
    of = lambda n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(least, LETTERS + 1)]))


def index_catalog(catalog: DataFrame, path: str) -> SearchIndex:
    """Writes the groups of a catalog to a new folder."""
    strings = catalog.select("book_id", F.lower("title").alias("t"), F.lower("author").alias("a"))
    strings.write.parquet(f"{path}/strings")
    dealt = grams_of(strings).distinct().repartition("part").sortWithinPartitions("part", "gram", "book_id")
    dealt.write.partitionBy("part").parquet(f"{path}/postings")
    counts = catalog.sparkSession.read.parquet(f"{path}/postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/counts")
    return open_index(catalog.sparkSession, path)


def grams_of(strings: DataFrame) -> DataFrame:
    each = strings.select("book_id", F.explode(F.array("t", "a")).alias("s")).where("s <> ''")
    return each.select("book_id", F.explode(groups(F.col("s"), 1)).alias("gram")).withColumn("part", part_of(F.col("gram")))


def asked_groups(catalog: DataFrame, grams: DataFrame) -> SearchIndex:
    """The part of an index that some groups need, for one search."""
    strings = catalog.select("book_id", F.lower("title").alias("t"), F.lower("author").alias("a"))
    postings = written(grams_of(strings).join(grams, "gram", "left_semi").distinct(), "postings")
    return SearchIndex(postings, postings.groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n")), strings, stored=False)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts", "strings")))


def only(index: SearchIndex, stored: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of these groups, from their parts alone; of few groups the scan knows the names."""
    if not index.stored:
        return stored
    parts = [r[0] for r in grams.select(part_of(F.col("gram"))).distinct().collect()]  # PARTS at most
    out = stored.where(F.col("part").isin(parts))
    few = grams.limit(NAMED + 1).collect()
    return out.where(F.col("gram").isin([r[0] for r in few])) if len(few) <= NAMED else out


def search_catalog(queries: DataFrame, catalog: DataFrame | SearchIndex, limit: int = 20) -> DataFrame:
    """(query_id, rank, book_id): the first books by id whose title or author holds the query; blank ones find nothing. Equal queries are answered once.

    Without an index, only the groups that are asked for are made.
    """
    asked = written(queries.select("query_id", F.lower(strip(F.col("q"))).alias("q")).where("q <> ''"), "asked")
    q = asked.select("q").distinct()
    own = F.when(F.length("q") <= LETTERS, F.array("q")).otherwise(groups(F.col("q"), LETTERS))
    each = written(q.select("q", F.explode(own).alias("gram")), "groups")
    index = catalog if isinstance(catalog, SearchIndex) else asked_groups(catalog, each.select("gram").distinct())
    n = each.join(only(index, index.counts, each.select("gram").distinct()).select("gram", "n"), "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    way = written(n.where("n > 0").select("q", "gram"), "ways")
    met = way.join(only(index, index.postings, way.select("gram").distinct()).select("gram", "book_id"), "gram").select("q", "book_id")
    short = met.where(F.length("q") <= LETTERS)
    looked = met.where(F.length("q") > LETTERS).join(index.strings, "book_id")
    holds = lambda c: F.coalesce(F.col(c).contains(F.col("q")), F.lit(False))
    long = looked.where(holds("t") | holds("a")).select("q", "book_id")
    first = F.row_number().over(W.partitionBy("q").orderBy("book_id"))
    found = short.unionAll(long).withColumn("rank", first).where(F.col("rank") <= limit)
    return asked.join(found, "q").select("query_id", "rank", "book_id")
