"""A training corpus from documents: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import decontaminate, mixing, near_dedup, token_binary, toxicity
from dialoom.llm.common import discard, materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels does not call toxic.

    Null, empty and wordless texts and rows without an id stay; repeated rows
    share their fate; no labels, nothing goes; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the least id, nulls first.

    Null, empty and wordless texts all stay; of repeated rows one stays.
    """
    return near_dedup.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their benchmark passages; those that are mostly benchmark go.

    Null and empty texts stay as they are; repeated rows are cut alike;
    n_chars is that of the text that is left, null for a null text.
    """
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    The null source is a source; texts without words go once; repeated rows
    are taken equally often; an empty table gives none.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token ids in shard files, read back: one row a document.

    A null text is the end id alone; null ids come first; copies of one id stay
    separate documents; other columns are not read.
    """
    return token_binary.ids_roundtrip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("token_binary", tokens),
]

#: Learnt scores, sampled buckets and files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage has read goes once the next one's rows are written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = materialize(made, name)
        if i:
            discard(docs)
        docs = made
    return docs
