"""Pairs and block results from replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.replies import pairs_of
from dialoom.functions.text import clean_question

#: Errors of a block: no reply came, or none of it was a valid pair.
NO_REPLY, NO_PAIRS = "LLM call failed", "No Q&A pairs extracted"


def block_results(replies: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Each block with qa_pairs (question cleaned, raw block as source), success, error and qa_count.

    `replies` has doc_id, block_idx, block, response. No row is dropped.
    """
    found = replies.withColumn("found", pairs_of(F.col("response")))
    record = F.transform("found", lambda p: F.struct(clean_question(p["question"], prefixes).alias("question"), p["answer"].alias("answer"), F.col("block").alias("source_text")))
    error = F.when(F.col("response").isNull(), NO_REPLY).when(F.size("found") == 0, NO_PAIRS)
    ok = F.col("error").isNull()
    return found.withColumn("error", error).select(
        "doc_id", "block_idx", "block", "response", ok.alias("success"), "error",
        F.when(ok, F.size("found")).otherwise(0).cast("long").alias("qa_count"), F.when(ok, record).alias("qa_pairs"))


def qa_records(results: DataFrame) -> DataFrame:
    """A row for each pair: doc_id, block_idx, pair_idx, question, answer, source_text; order in the keys, no deduplication."""
    rows = results.where("success").select("doc_id", "block_idx", F.posexplode("qa_pairs").alias("pair_idx", "p"))
    return rows.select("doc_id", "block_idx", F.col("pair_idx").cast("long").alias("pair_idx"), "p.question", "p.answer", "p.source_text")


def number_pairs(records: DataFrame) -> DataFrame:
    """Running numbers from 1 of a document's pairs, in block order."""
    order = Window.partitionBy("doc_id").orderBy("block_idx", "pair_idx")
    return records.withColumn("pair_no", F.row_number().over(order).cast("long"))


def error_log(results: DataFrame) -> DataFrame:
    """Failed blocks, numbered from 1, with the reply where there was one."""
    return results.where("not success").select("doc_id", (F.col("block_idx") + 1).alias("block_no"), "error", "response", "block")


def success_log(results: DataFrame) -> DataFrame:
    """Pairs with their running number and their block's number from 1."""
    return number_pairs(qa_records(results)).select("doc_id", "pair_no", (F.col("block_idx") + 1).alias("block_no"), "question", "answer")
