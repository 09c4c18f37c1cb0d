"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in shuffled order, over and over up to
`max_repeat` times. A document's virtual finish time is the source's tokens up
to and with it, divided by the source's target. One global order by that time,
cut at the total budget, serves all sources in proportion.

Prefix sums run in two levels, so that no source's documents meet in one task:
a source is dealt into `fan_out` ranges of its shuffle key, and the global
order into ranges of virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.common import discard, free_name, materialize, table

WEIGHTS = (3, 1, 2)
_HEX = 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of seed and id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """A row for each source of `sizes` (source, source_size): its target.

    Weights repeat along sources in code point order, null last. A target is
    the source's share of `budget` times all sizes, at most `max_repeat` times
    its size; what that cuts off is shared out again by weight. With sources in
    order of the share at which they are full, the full ones come first.
    One task sees all sources, one row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("full_at", "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * max_repeat
    out = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
        .withColumn("full_at", cap / F.col("weight"))
        .withColumn("place", F.row_number().over(full))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("first_open", F.min(F.when(F.col("full_at") > F.col("level"), F.col("place"))).over(every))
        .withColumn("share", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(every))
    )
    open_ = F.col("place") >= F.col("first_open")
    target = F.when(F.coalesce(open_, F.lit(False)), F.col("weight") * F.col("share")).otherwise(cap.cast("double"))
    return out.select("source", "source_size", "rank", target.alias("target"))


def _time_range(finish: Column, steps: int = 4096) -> Column:
    """Ranges of virtual time, ascending: even up to 4, then by powers of two."""
    far = F.lit(4 * steps) + F.floor(F.log2(F.greatest(finish, F.lit(4.0))) * 64)
    return F.when(finish < 4, F.floor(finish * steps)).otherwise(far).cast("long")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
             budget: float = 1.5, max_repeat: int = 2, seed: int = 7, fan_out: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, key, part, source_size, target) and cuts by (source, part).

    A document's pass e is taken when its (key, id, size) is at most cuts[e].
    """
    part = F.shiftright("key", 4 * _HEX - fan_out.bit_length() + 1).cast("int").alias("part")
    narrow = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        .withColumn("key", shuffle_key(F.col("doc_id"), seed)).select("*", part), "mix")
    parts = narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, budget, max_repeat)
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = parts.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).alias("l")
    starts = materialize(left.join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
                         .select("l.source", "part", "before", "source_size", "rank", "target"), "mix-parts")
    a, b = narrow.alias("a"), starts.alias("b")
    both = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part"))
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(
        a.join(b, both).select("a.*", "before", "source_size", "rank", "target")
        .withColumn("upto", F.col("before") + F.sum("size").over(own)).drop("before"), "mix-placed")
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    items = (
        placed.where((F.col("target") > 0) & (F.col("size") > 0))
        .withColumn("pass", F.explode(F.array(*[F.lit(e) for e in range(max_repeat)])))
        .withColumn("finish", finish).withColumn("range", _time_range(F.col("finish")))
    )
    ranges = items.groupBy("range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.select("range", (F.sum("range_size").over(Window.orderBy("range")) - F.col("range_size")).alias("earlier"))
    total = narrow.agg((F.sum("size") * F.lit(float(budget))).alias("budget"), F.lit(1).alias("one"))
    queue = Window.partitionBy("range").orderBy("finish", "rank", "pass", "upto", "key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most some ten thousand ranges, whatever the input; one row of total.
    ordered = items.withColumn("in_range", F.sum("size").over(queue)).join(F.broadcast(ranges), "range").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    taken = ordered.where(F.col("earlier") + F.col("in_range") <= F.col("budget"))
    last = taken.groupBy("source", "part").agg(*[F.max(F.when(F.col("pass") == e, F.struct("key", "doc_id", "size"))).alias(f"cut{e}") for e in range(max_repeat)])
    ends = last.groupBy("source").agg(*[F.max(f"cut{e}").alias(f"cut{e}") for e in range(max_repeat)])
    cuts = starts.alias("l").join(ends.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.source", "l.part", *[f"r.cut{e}" for e in range(max_repeat)])
    cuts = materialize(cuts, "mix-cuts")
    discard(narrow, starts)
    return placed, cuts


def _copies(cuts: list[Column], key: Column, doc_id: Column, size: Column) -> Column:
    me = F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size"))
    copies = F.lit(0)
    for cut in cuts:
        copies = copies + F.when(cut.isNotNull() & (me <= cut), 1).otherwise(0)
    return copies


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Null and wordless texts have size 0 and take 0; the null source is a source;
    repeated rows share their fate. The order is fixed by seed and ids, so
    reruns agree. An empty table gives no rows.
    """
    placed, cuts = mix_plan(docs, **options)
    n = options.get("max_repeat", 2)
    both = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.part") == F.col("c.part"))
    joined = placed.alias("p").join(cuts.alias("c"), both, "left")
    copies = _copies([F.col(f"c.cut{e}") for e in range(n)], F.col("p.key"), F.col("p.doc_id"), F.col("p.size"))
    return joined.select("p.doc_id", "p.size", "p.source_size", "p.target", (F.col("p.size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """The mix itself: rows of `docs` as often as it takes them, all columns kept.

    Documents without words weigh nothing and go once for their source's place in the mix.
    """
    placed, cuts = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    n, fan_out = options.get("max_repeat", 2), options.get("fan_out", 1024)
    discard(placed)
    key, side = free_name(docs, "mix_key"), free_name(docs, "mix_cut")
    shift = 4 * _HEX - fan_out.bit_length() + 1
    keyed = docs.withColumn(key, shuffle_key(F.col(f"`{id_col}`"), seed))
    cuts = cuts.select(F.struct("*").alias(side))
    where = F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(f"`{side}`.source")) & (F.shiftright(F.col(f"`{key}`"), shift).cast("int") == F.col(f"`{side}`.part"))
    size = word_count(F.col(f"`{text_col}`"))
    copies = _copies([F.col(f"`{side}`.cut{e}") for e in range(n)], F.col(f"`{key}`"), F.col(f"`{id_col}`"), size)
    again = free_name(docs, "mix_copy")
    return (
        keyed.join(cuts, where, "left").withColumn(again, F.explode(F.array_repeat(F.lit(1), F.when(size == 0, 1).otherwise(copies))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
