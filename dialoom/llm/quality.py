"""Quality rules with host verdicts: failures by host, shrunk by an empirical beta prior.

Each document is tested by rules of its own. Failures are counted by host; the
rates of all hosts give each rule a beta prior (by moments), which draws the
rate of a host with few documents to the mean. A host of which the shrunk rate
of some rule is beyond its limit is rejected, with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import SPACE_RUN, free_name, let, materialize, table

#: Host limits: the shrunk failure rate beyond which a host goes.
RULES = {"short": 0.9, "repetitive": 0.5, "symbols": 0.5, "dup_lines": 0.5}
#: Prior strength in documents, where the hosts' rates vary too little or too much to tell.
STRENGTH = (2.0, 10_000.0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included; from hashes of the words.

    Windows are sorted by hash, so equal ones meet; all steps take n log n at most.
    """
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def covered(starts: Column) -> Column:
        # A window adds the words that the one before it doesn't reach.
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"].cast("long"))

    def starts_of(hs: Column) -> Column:
        def pick(pairs: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
            marked = F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.array_compact(marked))

        return let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), pick)

    def count(hs: Column) -> Column:
        # Most texts repeat no window: a set of plain numbers tells.
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(starts_of(hs), covered))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(windows, count))


def measures(text: Column) -> Column:
    """Struct of a text's measures; null is an empty text."""
    text = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            let(F.transform(ws, lambda w: F.xxhash64(w)), repeated_words).alias("n_repeat_words"),
        )

    return let(words(text), of)


def rule_failures(m: Column) -> dict[str, Column]:
    return {
        "short": m["n_words"] < 50,
        "repetitive": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "dup_lines": 2 * m["lines"]["dup"] > m["lines"]["n"],
    }


def host_verdicts(failures: DataFrame, limits: dict[str, float] = RULES) -> DataFrame:
    """Rows (host, n, shrunk rate of each rule, rejected) from rows (host, a boolean for each rule)."""
    counts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(r) for r in limits])
    rate = lambda r: F.col(r) / F.col("n")
    # One row: mean of all documents and variance between hosts.
    spread = counts.agg(F.lit(1).alias("one"), *[(F.sum(r) / F.sum("n")).alias(f"{r}_mean") for r in limits], *[F.coalesce(F.var_pop(rate(r)), F.lit(0.0)).alias(f"{r}_var") for r in limits])

    def strength(r: str) -> Column:
        mean, var = F.col(f"{r}_mean"), F.col(f"{r}_var")
        return F.when(var > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), mean * (1 - mean) / var - 1))).otherwise(F.lit(STRENGTH[1]))

    joined = counts.withColumn("one", F.lit(1)).join(F.broadcast(spread), "one")
    shrunk = joined.withColumns({f"{r}_rate": (F.col(r) + F.col(f"{r}_mean") * strength(r)) / (F.col("n") + strength(r)) for r in limits})
    rejected = F.lit(False)
    for r, limit in limits.items():
        rejected = rejected | (F.col(f"{r}_rate") > limit)
    return shrunk.select("host", "n", *[f"{r}_rate" for r in limits], rejected.alias("rejected"))


def judge(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` with struct `m` of measures, `base_failed` and `kept`; of these, one whose name is among `keep` has underscores before it.

    Null and wordless texts have no words and fail. The null host is a host.
    Repeated rows count as often as they stand. Documents of hot hosts are
    counted before they meet; the join back splits hot hosts at run time.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in keep])
    host, m, base_failed, kept = (free_name(own, x) for x in ("host", "m", "base_failed", "kept"))
    keep_cols = [F.col(f"`{c}`") for c in keep]
    narrow = materialize(docs.select(*keep_cols, F.col(f"`{host_col}`").alias(host), measures(F.col(f"`{text_col}`")).alias(m)), "quality")
    failed = rule_failures(F.col(m))
    verdicts = host_verdicts(narrow.select(F.col(host).alias("host"), *[c.alias(r) for r, c in failed.items()]))
    side = free_name(narrow, "bad_host")
    bad = verdicts.where("rejected").select(F.struct("host").alias(side))
    base = F.col(f"{m}.n_words").isNull() | failed["short"] | failed["repetitive"]
    return (
        narrow.join(bad, F.col(host).eqNullSafe(F.col(f"{side}.host")), "left")
        .select(*keep_cols, m, base.alias(base_failed), (~base & ~failed["symbols"] & ~failed["dup_lines"] & F.col(side).isNull()).alias(kept))
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; null texts have no words."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words", "base_failed", "kept")
