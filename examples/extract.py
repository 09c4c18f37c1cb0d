"""Three ways to run the chain on a PDF: `python examples/extract.py file.pdf [basic|file|custom]`."""

from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

from dialoom.functions.constants import KNOWN_PREFIXES
from dialoom.operators.responders import HttpResponder
from dialoom.plans import pipeline
from dialoom.plans.cli import finish
from dialoom.plans.config import Config, load_config


def basic(pdf: str) -> Config:
    """The leading tenth of the blocks, to see whether all is set up."""
    return Config(pdf_filename=pdf, extract_ratio=0.1)


def from_file(pdf: str) -> Config:
    """Settings of the YAML file beside this script, then of the environment."""
    return replace(load_config(str(Path(__file__).with_name("settings.yaml"))), pdf_filename=pdf)


def custom(pdf: str) -> Config:
    """Larger blocks, only those with question and answer, and more speakers' names."""
    return Config(pdf_filename=pdf, max_block_size=2000, min_block_size=50, enable_qa_filter=True, extract_ratio=0.2, known_prefixes=[*KNOWN_PREFIXES, "记者问", "听众", "投资者", "学生"])


WAYS = {"basic": basic, "file": from_file, "custom": custom}


def run(config: Config) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from dialoom.sources.documents import read_pdf

    responder = HttpResponder(config.model_name, config.ollama_host, config.temperature)
    if not responder.available() and not responder.pull():
        print(f"Model {config.model_name} is not to be had at {config.ollama_host}")
        return 1
    spark = SparkSession.builder.appName("example").getOrCreate()
    blocks = read_pdf(spark, config.pdf_filename).withColumn("doc_id", F.col("path")).persist()
    done = pipeline.process(spark, blocks, responder, config)
    return finish(done.stats.toLocalIterator(), config.output_path)


if __name__ == "__main__":
    sys.exit(run(WAYS[sys.argv[2] if len(sys.argv) > 2 else "basic"](sys.argv[1])))
