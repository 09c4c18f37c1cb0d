"""Blocks from paragraphs: greedy merge, size filter, prefix sample, dense index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.folds import emitted, let
from dialoom.functions.text import has_qa


def merge_blocks(parts: Column, max_size: int, min_size: int) -> Column:
    """Array of (seg_no, block): paragraphs joined while their lengths fit in `max_size`.

    A paragraph too long by itself is a block of its own. Blocks shorter than
    `min_size`, separators included, go; numbers stay those before that. A
    scan finds where blocks start; they are joined after it, so no block's
    text is copied while it grows. Time grows with the paragraphs.
    """

    def opens(s: Column, n: Column) -> Column:
        return (s["i"] == 0) | (s["size"] + n > max_size)

    def step(s: Column, n: Column) -> Column:
        return F.struct((s["i"] + 1).alias("i"), (n + F.when(opens(s, n), 0).otherwise(s["size"])).alias("size"))

    def join(ps: Column) -> Column:
        def joined(starts: Column) -> Column:
            def block(a: Column, k: Column) -> Column:
                # Element by element: `slice` goes through the whole array for each block.
                end = F.coalesce(F.get(starts, k + 1), F.size(ps))
                own = F.transform(F.sequence(a, end - 1), lambda j: F.get(ps, j))
                return F.struct(k.alias("seg_no"), F.array_join(own, "\n\n").alias("block"))

            return F.transform(starts, block)

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"))
        return let(emitted(F.transform(ps, F.char_length), zero, step, opens, lambda s, n: s["i"], "int"), joined)

    return F.filter(let(parts, join), lambda b: F.char_length(b["block"]) >= min_size)


def blocks(df: DataFrame, parts: str, keys: list[str], *, max_size: int = 1500, min_size: int = 100) -> DataFrame:
    """Rows (keys..., seg_no, block) of the documents' paragraph arrays; one row's work stays in its row."""
    # A cross of row and expression: the array is evaluated once, then exploded.
    return df.select(*keys, F.inline(merge_blocks(F.col(parts), max_size, min_size))).select(*keys, F.col("seg_no").cast("long").alias("seg_no"), "block")


def leading(blocks: Column, ratio: float) -> Column:
    """The leading share of an array, at least one element; all from ratio 1, none up to 0."""
    if ratio >= 1:
        return blocks
    if ratio <= 0:
        return F.slice(blocks, 1, 0)
    return let(blocks, lambda b: F.slice(b, F.lit(1), F.greatest((F.size(b) * F.lit(float(ratio))).cast("int"), F.lit(1))))


def chosen_blocks(df: DataFrame, parts: str, keys: list[str], *, max_size: int = 1500, min_size: int = 100, qa_only: bool = False, ratio: float = 1.0) -> DataFrame:
    """Rows (keys..., seg_no, block, block_idx) of a document's blocks: those with question and answer if `qa_only`, then their leading share, numbered from 0.

    All of it happens within the document's row: nothing is shuffled.
    """
    found = merge_blocks(F.col(parts), max_size, min_size)
    if qa_only:
        found = F.filter(found, lambda b: has_qa(b["block"]))
    rows = df.select(*keys, F.posexplode(leading(found, ratio)).alias("_at", "_block"))
    return rows.select(*keys, F.col("_block.seg_no").cast("long").alias("seg_no"), "_block.block", F.col("_at").cast("long").alias("block_idx"))


def filter_qa(df: DataFrame, block: str = "block") -> DataFrame:
    """Blocks that hold question and answer; to be applied before a sample is taken."""
    return df.where(has_qa(F.col(block)))


def sample_prefix(df: DataFrame, ratio: float, *, key: str = "doc_id", order: str = "seg_no") -> DataFrame:
    """The leading share of each document's block rows, at least one; all from ratio 1, none up to 0. For blocks that are rows already; see `chosen_blocks`."""
    if ratio >= 1:
        return df
    if ratio <= 0:
        return df.limit(0)
    own = Window.partitionBy(key)
    ranked = df.withColumn("_rank", F.row_number().over(own.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(own))
    return ranked.where(F.col("_rank") <= F.greatest((F.col("_n") * F.lit(float(ratio))).cast("int"), F.lit(1))).drop("_rank", "_n")


def index_blocks(df: DataFrame, *, key: str = "doc_id", order: str = "seg_no") -> DataFrame:
    """Dense numbers from 0 of the block rows that are left."""
    return df.withColumn("block_idx", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def index_long(df: DataFrame, ratio: float = 1.0, *, key: str = "doc_id", order: str = "seg_no", stretch: int = 10_000) -> DataFrame:
    """The leading share of each document's block rows, numbered from 0, as `sample_prefix` and `index_blocks` do it, for documents of any length.

    Rows are ranked within stretches of `order`; stretches are counted, and
    their counts added up along each document. No task gets a document's rows.
    """
    if ratio <= 0:
        return df.limit(0).withColumn("block_idx", F.lit(0).cast("long"))
    placed = df.withColumn("_stretch", F.floor(F.col(order) / stretch))
    own = Window.partitionBy(key)
    counts = placed.groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.select(
        F.struct(F.col(key).alias("k"), F.col("_stretch").alias("s"), (F.sum("_n").over(own.orderBy("_stretch")) - F.col("_n")).alias("before"), F.sum("_n").over(own).alias("all")).alias("_sums"))
    same = F.col(key).eqNullSafe(F.col("_sums.k")) & (F.col("_stretch") == F.col("_sums.s"))
    rank = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(order)) - 1
    ranked = placed.withColumn("_rank", rank).join(sums, same).withColumn("block_idx", (F.col("_rank") + F.col("_sums.before")).cast("long"))
    if ratio < 1:
        ranked = ranked.where(F.col("block_idx") < F.greatest((F.col("_sums.all") * F.lit(float(ratio))).cast("long"), F.lit(1)))
    return ranked.select(*df.columns, "block_idx")
