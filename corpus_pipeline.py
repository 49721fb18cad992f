"""From raw documents to token ids: the stages a training corpus goes through.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and hands what it reads back to the next one.  All
stages but the last return the columns of ``documents``; texts that a stage edits get
a new ``n_chars``.  Other columns than these are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from cohortloom.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PASSAGE_BYTES = 200
PASSAGE_WORDS = 51
BATCH_BYTES = 4 << 20


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")}
                            ).select(*COLUMNS)


def _small_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of a few megabytes, as they take memory on both sides.

    Spark's own limit is 10,000 rows or 64 MB.  It is read when the stage is written, so the
    setting stays in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the rules go as a whole."""
    judged = quality_rules.quality_rules(docs.select(*COLUMNS))
    return _with_text(judged.filter("kept"), "clean_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Shingles and bits are those of the operator's own query: three words, at most three bits.
    """
    _small_batches(spark)
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that also occur elsewhere go; documents stay, if without text.

    51 words of three letters and their blanks take 203 bytes, so such passages are found by
    strings of 200; every copy goes, shorter repeats stay.
    """
    _small_batches(spark)
    return _with_text(suffix_dedup.repeats(
        docs.select(*COLUMNS), keep_text=True, length=PASSAGE_BYTES, gram=64,
        min_words=PASSAGE_WORDS), "kept_text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = docs.select(*COLUMNS)
    return mixing.repeat_rows(docs, mixing.mix(stored(mixing.sizes(docs))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to.

    Blocks are smaller than the operator's own: ids and texts leave the task whole, which
    takes the memory.
    """
    _small_batches(spark)
    return bpe.encode(docs, block=4 << 20)


STAGES = [("quality_rules", clean), ("near_duplicates", drop_near_copies),
          ("repeated_passages", drop_repeats), ("mixing", mix), ("bpe", encode)]

# The rounding of the mix is drawn from a hash that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
