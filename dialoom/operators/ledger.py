"""Replies that last: prompts are answered in chunks, each committed before the next one is asked.

A run that dies keeps the replies of all committed chunks, which lead the run
in document and block order. Called again, it sends only prompts that have no
reply yet. Nothing is held on the driver but chunk numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources import jsonl

REPLIES = "ask_key string, response string, asked_in int"


def ask_key(doc: Column, block: Column, prompt: Column) -> Column:
    """One question to the model: a prompt at its place in its document. Another prompt at that place is another question."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("\n", part(doc), part(block), part(prompt)), 256)


@dataclass(frozen=True)
class Ledger:
    """Committed replies below `path`, a folder for each chunk.

    A chunk counts once its writer has committed it; what a chunk that was
    cut off has left is removed when the next one is begun.
    """

    spark: SparkSession
    path: str

    def _folder(self, chunk: int) -> str:
        return f"{self.path.rstrip('/')}/chunk={chunk:06d}"

    def chunks(self) -> list[int]:
        """Numbers of the committed chunks."""
        return [n for n in jsonl.numbered(self.spark, self.path, "chunk") if jsonl.exists(self.spark, f"{self._folder(n)}/_SUCCESS")]

    def replies(self) -> DataFrame:
        """Rows (ask_key, response, asked_in) of committed chunks; a later reply to a question replaces a failed one."""
        own = [self._folder(n) for n in self.chunks()]
        if not own:
            return self.spark.createDataFrame([], REPLIES)
        rows = self.spark.read.schema(REPLIES).parquet(*own)
        best = F.max_by("response", F.when(F.col("response").isNotNull(), F.col("asked_in")))
        return rows.groupBy("ask_key").agg(best.alias("response"), F.min("asked_in").alias("asked_in"))

    def missing(self, asks: DataFrame, *, retry_failed: bool = False) -> DataFrame:
        """Those of `asks` (ask_key, ...) that have no reply; with `retry_failed`, those that have a failed one, too."""
        known = self.replies()
        return asks.join((known.where("response is not null") if retry_failed else known).select("ask_key"), "ask_key", "left_anti")

    def commit(self, answered: DataFrame, chunk: int) -> None:
        answered.select("ask_key", "response", F.lit(chunk).alias("asked_in")).write.mode("overwrite").parquet(self._folder(chunk))

    def clear(self) -> None:
        jsonl.remove(self.spark, self.path)

    def answer(
        self, asks: DataFrame, responder, order: list[str], *, chunk_rows: int = 5000, max_chunks: int = 500, retry_failed: bool = False,
        after: Callable[[DataFrame, int], None] | None = None, stop_after: int | None = None) -> DataFrame:
        """`asks` (ask_key, prompt, ...) with the column `response`, all of it committed.

        Missing questions are dealt to chunks of some `chunk_rows` rows (more, if
        there would be over `max_chunks`) in the order of columns `order`, and
        written as such once. Then chunk by chunk is asked, in that order, by as
        many tasks as the chunk has partitions. `after(rows, chunk)` sees each
        chunk's rows, replies included, when they are committed; a question that stands in several
        rows is sent once. `stop_after` ends the run after so many chunks.
        """
        todo = self.missing(asks, retry_failed=retry_failed).dropDuplicates(["ask_key"])
        staged = f"{self.path.rstrip('/')}-asks"
        jsonl.remove(self.spark, staged)
        todo.write.parquet(f"{staged}/all")
        kept = self.spark.read.schema(todo.schema).parquet(f"{staged}/all")
        n = kept.count()
        chunks = max(1, min(max_chunks, -(-n // chunk_rows))) if n else 0
        first = max(self.chunks(), default=-1) + 1
        if n:
            # A few ranges to a chunk: its tasks. A range is a place in the order, so chunks follow each other in it.
            tasks = max(1, min(64, -(-n // chunks) // 64))
            dealt = kept.repartitionByRange(chunks * tasks, *order).withColumn("chunk", F.floor(F.spark_partition_id() / tasks).cast("int"))
            dealt.write.partitionBy("chunk").parquet(f"{staged}/dealt")
        for k in range(chunks):
            own = f"{staged}/dealt/chunk={k}"
            if not jsonl.exists(self.spark, own):
                continue  # ranges are estimated, so one may be empty
            if stop_after is not None and k >= stop_after:
                break
            rows = self.spark.read.schema(todo.schema).parquet(own)
            self.commit(responder.respond(rows), first + k)
            if after:
                after(rows.join(self.spark.read.schema(REPLIES).parquet(self._folder(first + k)).select("ask_key", "response"), "ask_key"), first + k)
        jsonl.remove(self.spark, staged)
        return asks.join(self.replies().select("ask_key", "response"), "ask_key", "left")
