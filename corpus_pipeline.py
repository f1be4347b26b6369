"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the runner writes it
as Parquet and rereads it as the next one's ``docs``. All but the last return the columns of
``documents``, whatever else a table carries and however it is named.

Defined cases, in all stages: an empty table stays empty; nulls in columns but doc_id, text and
source are kept as they are. What each stage does with null ids and texts, ties and repeated rows
is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.lines import cut_lines
from linkloom.llm.minhash import without_near_copies
from linkloom.llm.mixing import mixed
from linkloom.llm.packing import pack
from linkloom.llm.quality import passing, trusted_ids
from linkloom.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams look more like trusted text than junk.

    A null, empty or blank text fails. Rows without a doc_id are judged like others; rows that share a
    doc_id each by their own text; rows that repeat whole all stay or all go.
    """
    return passing(docs, trusted_ids(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; documents of which nothing is left go.

    Null and blank texts stay, as no line of them goes. Rows without a doc_id come first, rows that
    share one are ordered by a hash; rows that repeat whole share one fate and aren't compared.
    """
    found = cut_lines(docs)
    emptied = (F.col("lines_report.n_removed") > 0) & ~F.col("d.text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~emptied).select("d.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, similarity 0.8.

    That with the least doc_id stays, of rows that repeat it one. Null and blank texts are no copies.
    Rows without a doc_id stay unless a document with one has the same set.
    """
    return without_near_copies(docs, words=5, similarity=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source, a null text has no words; rows that repeat whole are units of their own.
    """
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    A null or empty text is the end id alone; rows that repeat are packed as often as they occur.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", source_mix),
    ("packing", packed),
]

#: A forest of hashes, a balanced sample and a tokenizer are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
