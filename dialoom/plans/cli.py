"""Command line: `python -m dialoom.plans.cli file.pdf [options]`."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from dialoom.operators.stats import NO_BLOCKS
from dialoom.plans import config as settings
from dialoom.plans.config import Config
from dialoom.plans.logs import logger

#: option, setting, type; an option that isn't given leaves the setting alone.
VALUES = (
    ("--output", "-o", "output_filename", str), ("--output-dir", None, "output_dir", str), ("--model", "-m", "model_name", str), ("--host", None, "ollama_host", str),
    ("--temperature", "-t", "temperature", float), ("--max-block-size", None, "max_block_size", int), ("--min-block-size", None, "min_block_size", int), ("--sample", None, "extract_ratio", float),
)
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Of these, 0 means that nothing was given.
NONZERO = ("max_block_size", "min_block_size")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dialoom", description="Question and answer pairs from documents")
    out.add_argument("pdf_file", nargs="?")
    out.add_argument("--config", "-c")
    for name, short, dest, kind in VALUES:
        out.add_argument(name, *([short] if short else []), dest=dest, type=kind)
    out.add_argument("--log-level", choices=LEVELS)
    for name in ("--create-config", "--enable-qa-filter", "--disable-qa-filter", "--validate"):
        out.add_argument(name, action="store_true")
    out.add_argument("--quiet", "-q", action="store_true")
    out.add_argument("--verbose", "-v", action="store_true")
    out.add_argument("--resume", action="store_true", help="go on where a run that died has left off: only prompts without a reply are sent")
    out.add_argument("--version", action="version", version="%(prog)s 1.0.0")
    return out


def merge(args: argparse.Namespace, env=os.environ) -> Config:
    """The command line over environment, file and defaults."""
    base = settings.load_config(args.config or settings.default_path(), env)
    given = {dest: getattr(args, dest) for *_, dest, _ in VALUES}
    given = {k: v for k, v in given.items() if v is not None and not (v == 0 and k in NONZERO) and v != ""}
    if args.pdf_file:
        given["pdf_filename"] = args.pdf_file
    if args.enable_qa_filter or args.disable_qa_filter:
        given["enable_qa_filter"] = not args.disable_qa_filter
    if level := "WARNING" if args.quiet else "DEBUG" if args.verbose else args.log_level:
        given["log_level"] = level
    return replace(base, **given)


def report(stats: dict, path: str) -> str:
    """A run's figures as text."""
    if not stats["success"]:
        return f"Failed: {stats['message']}"
    out = [
        f"Output: {path}", f"Pages: {stats['pdf_pages']}", f"Blocks: {stats['total_blocks']} ({stats['successful_blocks']} successful, {stats['failed_blocks']} failed)",
        f"Success rate: {stats['success_rate']:.1%}", f"Pairs: {stats['qa_pairs_extracted']} ({stats['avg_qa_per_block']:.1f} per successful block)",
    ]
    if stats["avg_question_length"] is not None:
        out += [f"{name}: {stats[f'avg_{key}_length']:.1f} ({stats[f'min_{key}_length']} to {stats[f'max_{key}_length']}) characters" for name, key in (("Questions", "question"), ("Answers", "answer"))]
    return "\n".join(out)


def finish(rows, path: str) -> int:
    """Prints the figures of each document; 1 if one failed or there was none."""
    done = []
    for row in rows:
        stats = row.asDict()
        print(f"{stats['doc_id']}\n{report(stats, path)}")
        done.append(stats["success"])
    if not done:
        print(report({"success": False, "message": NO_BLOCKS}, path))
    return 0 if done and all(done) else 1


def main(argv: list[str] | None = None) -> int:
    out = parser()
    args = out.parse_args(argv)
    if args.create_config:
        path = os.path.join("config", "config.yaml")
        settings.save_config(Config(), path)
        print(f"Wrote {path}")
        return 0
    config = merge(args)
    if not args.pdf_file and not args.validate:
        out.error("a PDF file is needed")
    log = logger(level=config.log_level, path=os.path.join(config.output_dir, "main.log"))

    from dialoom.operators.responders import HttpResponder
    from dialoom.plans import pipeline

    responder = HttpResponder(config.model_name, config.ollama_host, config.temperature)
    found = pipeline.validate(config, responder)
    for kind in ("issues", "warnings"):
        for text in found[kind]:
            print(f"{kind[:-1]}: {text}")
    if args.validate or not found["valid"]:
        return 0 if found["valid"] else 1

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from dialoom.sources.documents import read_pdf

    spark = SparkSession.builder.appName("dialoom").getOrCreate()
    try:
        blocks = read_pdf(spark, config.pdf_filename).persist()
        run = pipeline.process(spark, blocks.withColumn("doc_id", F.col("path")), responder, config, resume=args.resume, retry_failed=args.resume)
        return finish(run.stats.orderBy("doc_id").toLocalIterator(), config.output_path)
    except Exception:
        log.exception("the run failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
