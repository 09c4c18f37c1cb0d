"""Greedy blocks of documents that are too long for one row or one task.

The greedy merge is a finite automaton: all it remembers is how long the open
block is, and beyond `max_size` any length does the same. So a document is cut
into segments of paragraphs, and a segment is a table: for each length it can
be entered with, the length it is left with and how many blocks open in it.
Tables are composed along each document; then each segment, with the length
and number it is really entered with, is merged by itself, and pieces of one block
meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transitions(lengths: np.ndarray, max_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Length left with and blocks opened, for each length 0..max_size + 1 of the open block at the start; 0 is no open block.

    From any start, all paragraphs that fit are added; from the first that
    doesn't on, the merge is the same whatever came before, so it is worked
    out once for each paragraph, from the last to the first.
    """
    n, cap = len(lengths), max_size + 1
    upto = np.concatenate([[0], np.cumsum(np.minimum(lengths, cap), dtype=np.int64)])
    # after[i], opened[i]: of a block that opens at paragraph i.
    after, opened = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    following = np.searchsorted(upto, upto[:-1] + max_size, side="right") - 1
    following = np.maximum(following, np.arange(1, n + 1))
    for i in range(n - 1, -1, -1):
        j = following[i]
        after[i], opened[i] = (after[j], 1 + opened[j]) if j < n else (min(upto[n] - upto[i], cap), 1)
    start = np.arange(cap + 1)
    first = np.searchsorted(upto, np.maximum(max_size - start, 0), side="right") - 1
    first[start > max_size] = 0
    if n:
        first[0] = 0
    first = np.minimum(first, n)
    stays = first >= n
    out = np.where(stays, np.minimum(start + upto[n], cap), after[first])
    return out, np.where(stays, 0, opened[first])


def steps(out: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table as steps: starts, and from each on what is left with and opened; where nothing opens, what is added.

    A segment of n paragraphs has n + 2 steps at most, so tables are no larger than lengths.
    """
    value = out - np.where(opened == 0, np.arange(len(out)), 0)
    starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (opened[1:] != opened[:-1])]))
    return starts, value[starts], opened[starts]


def stepped(starts: np.ndarray, value: np.ndarray, opened: np.ndarray, size: int) -> tuple[int, int]:
    """The table's entry for `size`."""
    at = np.searchsorted(starts, size, side="right") - 1
    return int(value[at]) + (size if opened[at] == 0 else 0), int(opened[at])


def merged(lengths: np.ndarray, entered: int, max_size: int) -> np.ndarray:
    """Which paragraphs open a block, if the open one is `entered` long at the start (0: there is none)."""
    opens, size, some = np.zeros(len(lengths), bool), entered, entered > 0
    for i, n in enumerate(lengths.tolist()):
        if not some or size + n > max_size:
            opens[i], size, some = True, 0, True
        size += n
    return opens


def long_blocks(paras: DataFrame, *, key: str = "doc_id", order: str = "para_no", text: str = "text", max_size: int = 1500, min_size: int = 100, segment: Column | None = None, segment_rows: int = 20_000) -> DataFrame:
    """Rows (key, seg_no, block) of paragraph rows (key, order, text), as `segment.blocks` gives them for arrays.

    `order` numbers a document's paragraphs; `segment` is a number that grows
    with it and cuts the document into pieces of bounded size (by default
    `order` over `segment_rows`). Empty and null paragraphs don't count. A task
    holds a segment of lengths, its table or a segment's text, never a
    document; a null key is a document.
    """
    seg = (F.floor(F.col(order) / segment_rows) if segment is None else segment).cast("long")
    rows = paras.where(F.col(text) != "").select(F.col(key).alias("k"), seg.alias("s"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
    kind = paras.schema[key].dataType.simpleString()

    def table(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("o")
        made = steps(*transitions(batch.column("n").to_numpy(), max_size))
        return pa.table({"k": batch.column("k").slice(0, 1), "s": batch.column("s").slice(0, 1)} | {c: pa.array([x], pa.list_(pa.int32())) for c, x in zip(("starts", "value", "opened"), made)})

    lengths = rows.select("k", "s", "o", F.char_length("t").alias("n"))
    tables = lengths.groupBy("k", "s").applyInArrow(table, f"k {kind}, s long, starts array<int>, value array<int>, opened array<int>")

    def compose(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, number = object(), 0, 0
        for batch in arrived:
            sizes, numbers = [], []
            for k, *made in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                if k != at:
                    at, size, number = k, 0, 0
                sizes.append(size)
                numbers.append(number)
                size, more = stepped(*(x.values.to_numpy() for x in made), size)
                number += more
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int64())], names=["k", "s", "size", "first"])

    # A document's tables go by in order; only the length and number so far are held.
    entered = tables.repartition("k").sortWithinPartitions("k", "s").mapInArrow(compose, f"k {kind}, s long, size int, first long")

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("o")
        texts = left.column("t").to_pylist()
        size, first = right.column("size")[0].as_py(), right.column("first")[0].as_py()
        opens = np.flatnonzero(merged(np.array([len(t) for t in texts]), size, max_size)).tolist()
        ahead = 0 if opens and opens[0] == 0 else 1  # what comes before the first opening goes on with the block before
        bounds = [0] * ahead + opens
        blocks = ["\n\n".join(texts[a:b]) for a, b in zip(bounds, [*bounds[1:], len(texts)])]
        n = len(blocks)
        one = lambda name: pa.array([left.column(name)[0].as_py()] * n, left.schema.field(name).type)
        return pa.table({"k": one("k"), "s": one("s"), "seg_no": pa.array([first - ahead + i for i in range(n)], pa.int64()), "t": pa.array(blocks, pa.string())})

    cut = rows.groupBy("k", "s").cogroup(entered.groupBy("k", "s")).applyInArrow(pieces, f"k {kind}, s long, seg_no long, t string")
    # A block over several segments is its pieces, joined: of `max_size` characters at most, or one paragraph.
    parts = cut.groupBy("k", "seg_no").agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("ps"))
    block = F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n")
    return parts.select(F.col("k").alias(key), "seg_no", block.alias("block")).where(F.char_length("block") >= min_size)
