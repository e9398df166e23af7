"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import small_batches, written
from lexspark.llm.jaccard import one_of_each_class
from lexspark.llm.langid import accepted_documents
from lexspark.llm.lines import dedup_lines
from lexspark.llm.packing import packed_documents
from lexspark.llm.repeats import PASSAGE_BYTES, PASSAGE_WORDS, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay as they are."""
    small_batches(spark)
    return accepted_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that stand earlier, up to one edit."""
    return _as_documents(dedup_lines(docs.select(*COLUMNS)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    small_batches(spark)
    return one_of_each_class(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages of over 50 words that repeat, in the same document or another; a character that is cut in two goes.

    A passage is found by strings of 200 bytes. Null, empty and short texts stay; texts that repeat as a whole become empty.
    """
    small_batches(spark)
    found = remove_repeats(docs.select(*COLUMNS), span=PASSAGE_BYTES, words=PASSAGE_WORDS, as_text=True)
    return _as_documents(found.withColumnRenamed("kept", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    small_batches(spark)
    return packed_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Language models, byte spans and packing have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
