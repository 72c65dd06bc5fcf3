"""Corpus preparation: five stages from the documents table to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; :func:`run` stores what a stage returns and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import line_dedup, mixing, packing, simhash, toxicity
from flowlens.llm.common import scratch_path, table
from flowlens.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; it learns from the labels of the kept folds.

    Null and empty texts stay.  Repeated rows are judged alike.  Without labels
    the built-in words decide.  An empty table stays empty.
    """
    return toxicity.accepted(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text where it was cut.

    Null texts stay null; a document whose every line is a later copy has an
    empty text.  Rows that repeat both id and text are cut alike.  An empty table
    stays empty.
    """
    cut = line_dedup.dedup_lines(docs, into="__removed")
    size = F.when(F.size("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id, one row of it.

    All wordless and null texts are one component.  Rows without doc_id stay.  An
    empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target words.

    Texts without words go, as they have no share in any target.  A null source
    is a source of its own.  Equal rows come as often as the mix takes them
    together.  An empty table stays empty.
    """
    return mixing.repeat_by_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, placed in sequences of at most 2048 tokens.

    Null and empty texts are one token.  Repeated rows are packed one by one.  An
    empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses none of the stages in full; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
