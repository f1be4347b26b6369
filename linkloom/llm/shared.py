"""What the operators of this subpackage share: tables in the cluster's shared folder, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.tables import shared_dir, written

__all__ = ["NO_ID", "WORD", "WORD_GAP", "checkpointed", "held", "known_id", "plain", "shared_dir", "table", "words_of", "written"]

#: The characters that separate words, as a pattern for Java and for RE2.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a missing id counts as where tables are joined by id: null-safe keys would not keep the partitions that joins make.
NO_ID = -(2**63)


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``: what else a table carries never meets a name the operator makes."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def held(docs: DataFrame) -> Column:
    """A whole row as one struct ``d``, so that no name in it meets a name the operator makes."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
