"""Filter interaction audit: what each filter removes, in every order the filters can be applied in.

A document's failures are a mask of one bit a filter. Of each part of the
table (a language, say) only histograms over the masks are needed: of all
documents and of those with either label. They are stacked as rows and
multiplied by integer incidence matrices, masks by (order, step), that say
whether a mask is kept after a step, removed in it, redundant there or
failing that filter only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import SPACE_RUN, discard, let, materialize, table, tidy

#: Filters by bit; the last one looks at the whole table.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def incidence(n: int = len(FILTERS)) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of n filters, and matrices of 2^n masks by (order, step) for each outcome.

    `shapley` has how often a step's filter removes the mask over all orders.
    """
    orders = list(itertools.permutations(range(n)))
    out = {k: np.zeros((1 << n, len(orders) * n), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    removals = np.zeros((1 << n, n), np.int64)
    masks = np.arange(1 << n)
    for i, order in enumerate(orders):
        before = np.zeros(1 << n, bool)
        for j, f in enumerate(order):
            at, fails = i * n + j, (masks >> f & 1).astype(bool)
            out["removed"][:, at] = fails & ~before
            out["redundant"][:, at] = fails & before
            out["unique_fails"][:, at] = masks == 1 << f
            before |= fails
            out["kept"][:, at] = ~before
            removals[:, f] += out["removed"][:, at]
    for i, order in enumerate(orders):
        for j, f in enumerate(order):
            out["shapley"][:, i * n + j] = removals[:, f]
    return orders, out


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    bit = lambda failed, k: F.when(failed, 1 << k).otherwise(0)

    def of(ws: Column) -> Column:
        few = F.size(ws) < 100
        dull = 100 * F.size(F.array_distinct(ws)).cast("long") < 80 * F.size(ws).cast("long")
        loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long")
        return bit(few, 0) + bit(dull, 1) + bit(loud, 2) + bit(text.rlike(r"[#$%&*|]"), 3)

    return let(F.filter(F.split(text, SPACE_RUN), lambda w: w != ""), of)


def failures(docs: DataFrame, labels: DataFrame, *, part_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of a part by the filters that they fail.

    A null part is the empty one. A text is a copy (E) if any row of a smaller
    id has the same text; rows of one id are no copies of each other, and a
    null id is neither smaller nor greater than any. A document is good or
    toxic if any of its label rows says so; labels without a document count
    nothing. Repeated rows count as often as they stand.

    Rows of equal id, text and part become one with a count before they are
    shuffled, the least id of a text is found by partial minima, and it meets
    its own row by id and text: no task gets all copies of a text.
    """
    q = lambda c: F.col(f"`{c}`")
    text = F.coalesce(q(text_col), F.lit(""))
    each = docs.select(
        q(id_col).alias("id"), F.coalesce(q(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    rows = materialize(each.groupBy("id", "digest", "part", "own").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    said = labels.select(q("doc_id").alias("id"), q("quality").alias("quality"), q("toxic").alias("toxic")).where("id IS NOT NULL")
    said = said.groupBy("id").agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Rows without an id match nothing: only those with one are joined.
    named = rows.where("id IS NOT NULL").join(first, ["id", "digest"], "left").join(said, "id", "left")
    counted = named.select("part", (F.col("own") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"), "n", F.coalesce("good", F.lit(0)).alias("g"), F.coalesce("toxic", F.lit(0)).alias("t"))
    counted = counted.unionByName(rows.where("id IS NULL").select("part", F.col("own").alias("mask"), "n", F.lit(0).alias("g"), F.lit(0).alias("t")))
    out = materialize(counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic")), "audit-masks")
    discard(rows)
    return out


def outcomes(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step of `filters`, from rows (part, mask, n, good, toxic).

    A part is one row of three dense histograms, whatever the table's size;
    parts are multiplied where they lie.
    """
    size = 1 << len(filters)
    cells = masks.groupBy("part").agg(*[F.collect_list(F.struct(F.col("mask"), F.col(c).cast("long"))).alias(c) for c in ("n", "good", "toxic")])
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(c), i), F.lit(0).cast("long")))
    stacked = cells.select("part", F.concat(*[at(F.col(c)) for c in ("n", "good", "toxic")]).alias("stack"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def multiply(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, by = incidence(len(filters))
        names = pa.array(["".join(filters[f] for f in o) for o in orders for _ in o])
        steps = pa.array([j + 1 for o in orders for j in range(len(o))], pa.int32())
        for batch in arrived:
            for part, stack in zip(batch.column(0), batch.column(1)):
                n, good, toxic = np.array(stack.as_py(), np.int64).reshape(3, size)
                columns = [n @ by["kept"], n @ by["removed"], n @ by["redundant"], n @ by["unique_fails"], good @ by["removed"], toxic @ by["removed"], n @ by["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(names), pa.string()), names, steps, *map(pa.array, columns)], names=["part", "filter_order", "step", *COUNTS])
        tidy()

    return stacked.mapInArrow(multiply, schema)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Rows (part, filter_order, step, counts) of all orders; no documents, no rows. Odd cases are as in `failures`."""
    return outcomes(failures(docs, labels, **columns))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
