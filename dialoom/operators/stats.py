"""Run statistics and quality figures: one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NO_BLOCKS = "No text blocks to process"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


_LENGTHS = tuple(f"{f}_{k}" for f in ("question", "answer") for k in ("sum", "min", "max"))


def partial_stats(results: DataFrame) -> DataFrame:
    """Counts and sums of block results by document, that `merged_stats` adds up: rows (doc_id, blocks, successes, pairs, length sums and extremes).

    Lengths are summed within each block before the shuffle.
    """
    lengths = lambda f: F.transform(F.coalesce("qa_pairs", F.array().cast("array<struct<question:string,answer:string,source_text:string>>")), lambda p: F.char_length(p[f]))
    total = lambda f: F.aggregate(lengths(f), F.lit(0).cast("long"), lambda a, x: a + x)
    each = results.select(
        "doc_id", "success", "qa_count",
        *[c.alias(f"{f}_{k}") for f in ("question", "answer") for k, c in (("sum", total(f)), ("min", F.array_min(lengths(f))), ("max", F.array_max(lengths(f))))])
    return each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_blocks"), F.count_if("success").alias("successful_blocks"), F.sum("qa_count").alias("qa_pairs_extracted"), *_adding())


def _adding() -> list[Column]:
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    return [how[c.rsplit("_", 1)[1]](c).alias(c) for c in _LENGTHS]


def merged_stats(partials: DataFrame) -> DataFrame:
    """Partial statistics of several runs or batches as those of all their blocks, in any order or grouping."""
    return partials.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("total_blocks", "successful_blocks", "qa_pairs_extracted")], *_adding())


def finished_stats(sums: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Statistics from merged partial ones; see `run_stats`."""
    if documents is not None:
        sums = documents.select("doc_id", *[c for c in ("pages", "error") if c in documents.columns]).join(sums, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    blocks, ok, pairs = n("total_blocks"), n("successful_blocks"), n("qa_pairs_extracted")
    failed = F.coalesce("error", F.lit(NO_BLOCKS)) if "error" in sums.columns else F.lit(NO_BLOCKS)
    return sums.select(
        "doc_id", blocks.alias("total_blocks"), ok.alias("successful_blocks"), (blocks - ok).alias("failed_blocks"), _ratio(ok, blocks).alias("success_rate"),
        pairs.alias("qa_pairs_extracted"), _ratio(pairs, ok).alias("avg_qa_per_block"),
        (n("pages") if "pages" in sums.columns else F.lit(0).cast("long")).alias("pdf_pages"),
        F.try_divide("question_sum", "qa_pairs_extracted").alias("avg_question_length"), F.try_divide("answer_sum", "qa_pairs_extracted").alias("avg_answer_length"),
        *[F.col(f"{f}_{k}").cast("long").alias(f"{k}_{f}_length") for f in ("question", "answer") for k in ("min", "max")],
        (blocks > 0).alias("success"), F.when(blocks == 0, failed).alias("message"))


def run_stats(results: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Blocks, successes and pairs of each document, with means and extremes of pair lengths.

    Documents without blocks appear when `documents` (doc_id[, pages, error])
    is given, with zeros, success false and a message: their error, if any.
    Length figures are null without pairs.
    """
    return finished_stats(partial_stats(results), documents)


def question_sets(records: DataFrame) -> DataFrame:
    """The distinct questions of each document, as digests: rows (doc_id, question_sha256). Sets of several batches unite by `distinct`."""
    return records.select("doc_id", F.sha2(F.coalesce("question", F.lit("")), 256).alias("question_sha256")).distinct()


def finished_quality(sums: DataFrame, questions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """`extraction_quality` from merged partial statistics and united question sets."""
    found = sums.where("qa_pairs_extracted > 0").select(
        "doc_id", F.col("qa_pairs_extracted").alias("n"), (F.col("question_sum") / F.col("qa_pairs_extracted")).alias("q"), (F.col("answer_sum") / F.col("qa_pairs_extracted")).alias("a"))
    distinct = questions.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct"))
    return _scored(found.join(distinct, "doc_id", "left"), documents)


def extraction_quality(records: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Pairs, mean lengths, whether a question repeats, and a score of four parts, by document."""
    sums = records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.char_length("question")).alias("q"), F.avg(F.char_length("answer")).alias("a"),
        F.count_distinct(F.coalesce("question", F.lit(""))).alias("distinct"))
    return _scored(sums, documents)


def _scored(sums: DataFrame, documents: DataFrame | None) -> DataFrame:
    if documents is not None:
        sums = documents.select("doc_id").join(sums, "doc_id", "left")
    n, q, a = F.coalesce("n", F.lit(0)), F.coalesce("q", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    repeats = F.coalesce(F.col("n") != F.col("distinct"), F.lit(False))
    part = lambda when, points: F.when(when, F.lit(points)).otherwise(F.lit(0.0))
    score = part(q > 5, 0.3) + part(a > 10, 0.3) + part(~repeats & (n > 0), 0.2) + part(n > 0, 0.2)
    return sums.select("doc_id", n.cast("long").alias("total_pairs"), q.alias("avg_question_length"), a.alias("avg_answer_length"), repeats.alias("has_duplicates"), F.round(score, 6).alias("quality_score"))
