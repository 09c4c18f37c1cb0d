"""The chain over documents as they arrive. A row is a whole document; what runs on over batches is kept by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dialoom.operators import pairs, segment, stats
from dialoom.plans.config import Config
from dialoom.plans.pipeline import plan, prompts
from dialoom.sources.documents import text_parts


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_blocks(docs: DataFrame, config: Config) -> DataFrame:
    """Blocks of arriving documents, filtered if the settings say so; sampling needs whole batches."""
    out = segment.blocks(text_parts(docs), "parts", ["doc_id"], max_size=config.max_block_size, min_size=config.min_block_size)
    return segment.filter_qa(out) if config.enable_qa_filter else out


def stream_records(docs: DataFrame, responder, config: Config) -> DataFrame:
    """Pairs of arriving documents, as a stream: each row by itself, so nothing is kept between batches."""
    blocks = segment.chosen_blocks(text_parts(docs), "parts", ["doc_id"], max_size=config.max_block_size, min_size=config.min_block_size, qa_only=config.enable_qa_filter, ratio=config.extract_ratio)
    return pairs.qa_records(pairs.block_results(responder.respond(prompts(blocks)), config.known_prefixes))


def stream_pairs(docs: DataFrame, responder, config: Config, path: str, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes pairs, errors, partial statistics and question sets of each micro-batch below `path`.

    A batch that is run again replaces its own folders, and sends only prompts
    that have no committed reply yet. `run_stats` and `quality` merge what all
    batches have left.
    """

    def write(batch: DataFrame, number: int) -> None:
        parts = text_parts(batch)
        run = plan(parts, responder, config, f"{path}/results/batch={number}", resume=True)
        run.records.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
        pairs.error_log(run.results).write.mode("overwrite").parquet(f"{path}/errors/batch={number}")
        stats.partial_stats(run.results).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
        stats.question_sets(run.records).write.mode("overwrite").parquet(f"{path}/questions/batch={number}")
        parts.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        if done:
            done(run.records, number)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _left(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("batch")


def run_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all documents so far, from what each batch has left; none of their blocks is read again."""
    return stats.finished_stats(stats.merged_stats(_left(spark, path, "stats")), _left(spark, path, "documents").distinct())


def quality(spark: SparkSession, path: str) -> DataFrame:
    """Quality figures of all documents so far, from partial statistics and question sets."""
    return stats.finished_quality(stats.merged_stats(_left(spark, path, "stats")), _left(spark, path, "questions"), _left(spark, path, "documents").distinct())


def _numbering() -> StatefulProcessor:
    """Made here, so that it goes to workers whole: those of the driver don't see what was sent to executors."""

    class Numbering(StatefulProcessor):
        """A document's last pair number is its state; the pairs of a batch go on from there, in block order."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._last = handle.getValueState("last", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own = pd.concat(list(rows)).sort_values(["block_idx", "pair_idx"], kind="stable")
            last = self._last.get()[0] if self._last.exists() else 0
            own["pair_no"] = range(last + 1, last + 1 + len(own))
            self._last.update((last + len(own),))
            yield own

        def close(self) -> None:
            pass

    return Numbering()


#: What keyed state needs of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def number_stream(records: DataFrame) -> DataFrame:
    """Arriving pairs (doc_id, block_idx, pair_idx, ...) with `pair_no`, running on over micro-batches and restarts.

    Equal to `pairs.number_pairs` if later blocks of a document don't arrive
    in earlier batches. One number a document is kept; a task holds the pairs
    of one document in one batch. The session needs STATE_STORE.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*records.schema.fields, StructField("pair_no", LongType())])
    return records.groupBy("doc_id").transformWithStateInPandas(_numbering(), schema, "append", "none")
