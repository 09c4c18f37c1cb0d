"""Inputs derived from the driver's tables, which hold no transcripts of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.sources.documents import spread, table, text_lines, text_parts

#: Speakers' markers by role.
MARKERS = {"user": "网友", "assistant": "段永平", "system": "主持人"}


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: a layout block for each line of a document."""
    return text_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as paragraph arrays (doc_id, parts), made row by row."""
    return text_parts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: a marked paragraph for each turn; even conversations have full-width colons."""
    role = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in MARKERS.items()], F.lit("其他"))
    colon = F.when(F.col("conv_id") % 2 == 0, "：").otherwise(":")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(role, colon, text).alias("para"))


def transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 as paragraph arrays (doc_id, parts)."""
    rows = transcript(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "para"))).alias("rows"))
    return rows.select("doc_id", F.transform("rows", lambda r: r["para"]).alias("parts"))


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns followed by an assistant's: doc_id, block_idx (the user's turn), question, answer, block."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    found = turns.where("role = 'user' and next_role = 'assistant'")
    return found.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.concat(F.lit("网友："), F.col("text")).alias("question"), F.col("next_text").alias("answer"), F.concat(F.lit("网友："), F.col("text"), F.lit("\n\n段永平："), F.col("next_text")).alias("block"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3: replies in eight shapes by conversation; rows of `adjacent` with `response`."""
    pair = F.to_json(F.struct("question", "answer"))
    bare = F.concat(F.lit("["), pair, F.lit("]"))
    blank = F.concat(F.lit("["), F.to_json(F.struct("question", F.lit("  ").alias("answer"))), F.lit(', 7, {"question": "only"}]'))
    shape = F.col("doc_id") % 8
    response = (
        F.when(shape == 0, F.concat(F.lit("Here:\n```json\n"), bare, F.lit("\n```\nend"))).when(shape == 1, bare).when(shape == 2, pair)
        .when(shape == 3, F.concat(pair, F.lit("\n"), pair)).when(shape == 4, F.concat(F.lit("First "), pair, F.lit(" stray } then "), pair))
        .when(shape == 5, F.concat(F.lit('[{"question": "cut off'), F.col("question"))).when(shape == 6, F.lit(None).cast("string")).otherwise(blank))
    return adjacent(spark, sf_dir).withColumn("response", response)
