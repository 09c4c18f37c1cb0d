"""From layout blocks to pairs, logs and statistics: one lazy chain for all documents."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.text import flatten_lines, normalize_markers
from dialoom.operators import pairs, segment, stats
from dialoom.operators.ledger import Ledger, ask_key
from dialoom.operators.long_blocks import long_blocks
from dialoom.plans.config import Config
from dialoom.plans.prompt import prompt
from dialoom.sources import jsonl
from dialoom.sources.documents import document_facts, paragraph_arrays


def surviving_blocks(parts: DataFrame, config: Config) -> DataFrame:
    """Rows (doc_id, seg_no, block, block_idx) of paragraph arrays (doc_id, parts); filter, then sample, then number."""
    return segment.chosen_blocks(parts, "parts", ["doc_id"], max_size=config.max_block_size, min_size=config.min_block_size, qa_only=config.enable_qa_filter, ratio=config.extract_ratio)


def prompts(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("prompt", prompt(normalize_markers(F.col("block"))))


@dataclass(frozen=True)
class Run:
    """The outcome of a run: block results are written once, all else reads them."""

    results: DataFrame
    records: DataFrame
    stats: DataFrame
    config_used: dict[str, object] = field(default_factory=dict)


#: Settings that a run's figures echo.
ECHOED = ("model_name", "max_block_size", "min_block_size", "extract_ratio", "enable_qa_filter", "temperature")


def questions(blocks: DataFrame) -> DataFrame:
    """Blocks with their prompt and its key in the ledger of replies."""
    return prompts(blocks).withColumn("ask_key", ask_key(F.col("doc_id"), F.col("block_idx"), F.col("prompt")))


def surviving_long_blocks(layout: DataFrame, config: Config, segment_rows: int = 20_000) -> DataFrame:
    """Rows (doc_id, seg_no, block, block_idx) of layout blocks (doc_id, page_no, blk_no, text), as `surviving_blocks` gives them, for documents of any length.

    No task gets a document: paragraphs are dealt by groups of pages, or by
    parts of a page if one has more than `segment_rows` blocks.
    """
    most = (layout.agg(F.max("blk_no")).first()[0] or 0) + 1
    pages, page = max(1, segment_rows // most), F.col("page_no").cast("long")
    part = F.floor(page / pages) if most <= segment_rows else page * (most // segment_rows + 1) + F.floor(F.col("blk_no") / segment_rows)
    paras = layout.select("doc_id", "page_no", "blk_no", (page * (1 << 31) + F.col("blk_no")).alias("place"), flatten_lines(F.col("text")).alias("text"))
    out = long_blocks(paras, order="place", max_size=config.max_block_size, min_size=config.min_block_size, segment=part)
    if config.enable_qa_filter:
        out = segment.filter_qa(out)
    return segment.index_long(out, config.extract_ratio)


def plan(parts: DataFrame, responder, config: Config, path: str | None = None, documents: DataFrame | None = None, **how) -> Run:
    """Blocks, prompts, replies and results of paragraph arrays (doc_id, parts); see `plan_blocks`.

    Statistics have a row for each of `documents` (doc_id[, pages, error]), or
    else of `parts`, those without a block included.
    """
    return plan_blocks(surviving_blocks(parts, config), parts.select("doc_id") if documents is None else documents, responder, config, path, **how)


def plan_blocks(
    blocks: DataFrame, documents: DataFrame, responder, config: Config, path: str | None = None, *,
    resume: bool = False, retry_failed: bool = False, chunk_rows: int = 5000, after: Callable[[DataFrame, int], None] | None = None) -> Run:
    """Prompts, replies and results of numbered blocks (doc_id, seg_no, block, block_idx).

    With `path`, replies are committed there in chunks, in document and block
    order, before anything reads them: each prompt is sent once, whatever is
    computed from the replies. With `resume`, committed replies of an earlier
    run at `path` are used and only the other prompts are sent; without, such
    replies go first. `after(results, chunk)` sees each chunk's block results.
    Without `path` the chain stays lazy, for responders that cost nothing to ask.
    """
    results_of = lambda asked: pairs.block_results(asked, config.known_prefixes)
    if path is None:
        results = results_of(responder.respond(prompts(blocks)))
    else:
        ledger = Ledger(blocks.sparkSession, f"{path}/replies")
        if not resume:
            ledger.clear()
        seen = after and (lambda rows, chunk: after(results_of(rows), chunk))
        asked = ledger.answer(questions(blocks), responder, ["doc_id", "block_idx"], chunk_rows=chunk_rows, retry_failed=retry_failed, after=seen)
        results = results_of(asked)
        results.write.mode("overwrite").parquet(f"{path}/results")
        results = results.sparkSession.read.schema(results.schema).parquet(f"{path}/results")
    return Run(results, pairs.qa_records(results), stats.run_stats(results, documents), {k: getattr(config, k) for k in ECHOED})


def process(spark: SparkSession, blocks: DataFrame, responder, config: Config, *, long: bool = False, **how) -> Run:
    """Run over layout blocks (doc_id, page_no, blk_no, text[, page_count, error]) and write pairs and logs below the output folder.

    The output is emptied first. While the run lasts, pairs of each committed
    chunk are added to it, so that what a run leaves that dies is a valid
    prefix; at the end the whole is written in order. With `resume`, a run
    goes on where the one before it died, and ends with the same output. With
    `long`, documents may be longer than a task can hold. Other options are
    those of `plan_blocks`.
    """
    if not how.get("resume"):
        jsonl.remove(spark, config.output_path)

    def add(results: DataFrame, chunk: int) -> None:
        records = pairs.qa_records(results).orderBy("doc_id", "block_idx", "pair_idx")
        jsonl.save(records.select("question", "answer", "source_text"), f"{config.output_path.rstrip('/')}/chunk={chunk:06d}")

    path = os.path.join(config.output_dir, "_block_results")
    chosen = surviving_long_blocks(blocks, config) if long else surviving_blocks(paragraph_arrays(blocks), config)
    run = plan_blocks(chosen, document_facts(blocks), responder, config, path, after=add, **how)
    jsonl.save(run.records.orderBy("doc_id", "block_idx", "pair_idx").select("question", "answer", "source_text"), config.output_path)
    if config.enable_error_log:
        jsonl.save_log(pairs.error_log(run.results), os.path.join(config.output_dir, "extraction_errors.log"), "BLOCK", "ERROR", order=["doc_id", "block_no"])
    if config.enable_success_log:
        jsonl.save_log(pairs.success_log(run.results), os.path.join(config.output_dir, "extraction_success.log"), "QA_PAIR", order=["doc_id", "pair_no"])
    return run


def validate(config: Config, responder) -> dict:
    """Whether a run can start: issues forbid it, warnings don't."""
    issues, warnings = [], []
    if not os.path.exists(config.pdf_filename):
        issues.append(f"PDF file not found: {config.pdf_filename}")
    if not responder.connected():
        issues.append(f"Cannot reach the model server at {config.ollama_host}")
    elif not responder.available():
        warnings.append(f"Model {config.model_name} is not on the server")
    try:
        os.makedirs(config.output_dir, exist_ok=True)
    except OSError as e:
        issues.append(f"Cannot create {config.output_dir}: {e}")
    return {"valid": not issues, "issues": issues, "warnings": warnings}
