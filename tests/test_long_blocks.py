import random

import numpy as np
from pyspark.sql import functions as F

from dialoom.operators import segment
from dialoom.operators.long_blocks import long_blocks, merged, stepped, steps, transitions


def test_tables_equal_merging_from_each_length():
    pick = random.Random(8)
    for _ in range(200):
        most = pick.randint(1, 12)
        lengths = np.array([pick.choice([1, 2, 3, pick.randint(1, 30)]) for _ in range(pick.randint(1, 15))])
        out, opened = transitions(lengths, most)
        for start in range(most + 2):
            opens = merged(lengths, start, most)
            size = start
            for n, new in zip(lengths.tolist(), opens.tolist()):
                size = n if new else size + n
            assert (out[start], opened[start]) == (min(size, most + 1), opens.sum()), (lengths, most, start)


def test_tables_are_no_larger_than_their_segments():
    pick = random.Random(12)
    for _ in range(200):
        most = pick.choice([5, 40, 1500])
        lengths = np.array([pick.randint(1, pick.choice([3, 30, 2000])) for _ in range(pick.randint(1, 16))])
        out, opened = transitions(lengths, most)
        made = steps(out, opened)
        assert {len(x) for x in made} == {len(made[0])} and len(made[0]) <= len(lengths) + 2
        assert [stepped(*made, size) for size in range(most + 2)] == list(zip(out.tolist(), opened.tolist()))


def test_rows_give_the_blocks_of_arrays(spark):
    pick = random.Random(9)
    docs = [(None if i == 7 else i, ["x" * pick.choice([0, 1, 5, pick.randint(1, 80)]) for _ in range(pick.choice([0, 1, 3, 60]))]) for i in range(120)]
    arrays = spark.createDataFrame(docs, "doc_id long, parts array<string>")
    rows = arrays.select("doc_id", F.posexplode("parts").alias("para_no", "text"), F.lit("other").alias("k"), F.lit(1).alias("s")).repartition(5)
    full = arrays.select("doc_id", F.filter("parts", lambda p: p != "").alias("parts"))
    for most, least, step in ((40, 10, 4), (1, 1, 1), (500, 5, 7), (60, 1, 1000)):
        want = sorted(map(str, segment.blocks(full, "parts", ["doc_id"], max_size=most, min_size=least).collect()))
        assert sorted(map(str, long_blocks(rows, max_size=most, min_size=least, segment_rows=step).collect())) == want
    assert long_blocks(rows.limit(0)).count() == 0 and long_blocks(rows.where("text = ''")).count() == 0


def test_other_orders_and_segments(spark):
    """Layout blocks by page: the order is page and place, a segment some pages."""
    rows = spark.createDataFrame([("a", p, b, f"p{p} b{b}") for p in range(1, 30) for b in range(5)], "path string, page_no int, blk_no int, text string")
    rows = rows.withColumn("o", F.col("page_no").cast("long") * (1 << 32) + F.col("blk_no"))
    got = long_blocks(rows, key="path", order="o", segment=F.floor(F.col("page_no") / 4), max_size=33, min_size=1)
    arrays = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda r: r["text"]).alias("parts"))
    assert sorted(got.collect()) == sorted(segment.blocks(arrays, "parts", ["path"], max_size=33, min_size=1).collect()) and got.count() > 20


def test_one_long_document_is_dealt_over_tasks(spark):
    n = 400_000
    rows = spark.range(n).select(F.lit("doc").alias("doc_id"), F.col("id").alias("para_no"), F.repeat(F.lit("z"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    got = long_blocks(rows, max_size=100, min_size=1, segment_rows=10_000).select("seg_no", F.char_length(F.replace("block", F.lit("\n"), F.lit(""))).alias("n")).toPandas().sort_values("seg_no")
    opens = merged(np.arange(n) % 7 + 1, 0, 100)
    assert got.seg_no.tolist() == list(range(opens.sum())) and got.n.sum() == (np.arange(n) % 7 + 1).sum() and got.n.max() <= 100


def test_numbers_and_shares_by_stretches(spark):
    pick = random.Random(3)
    rows = [(d if d != 5 else None, s, f"b{s}") for d in range(12) for s in sorted(pick.sample(range(200), pick.choice([1, 3, 60])))]
    df = spark.createDataFrame(rows, "doc_id long, seg_no long, block string").repartition(4)
    for ratio in (1.0, 0.5, 0.29, 0.001, 0.0, 2.0):
        want = segment.index_blocks(segment.sample_prefix(df, ratio))
        for stretch in (1, 7, 1000):
            got = segment.index_long(df, ratio, stretch=stretch)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_runs_over_long_documents_end_alike(spark, tmp_path):
    from dialoom.operators.responders import RuleResponder
    from dialoom.plans import pipeline
    from dialoom.plans.config import Config

    pick = random.Random(6)
    rows = [(d, p, b, pick.choice(["网友：", "段永平：", " ", "听说"]) + "x" * pick.randint(0, 30) + "\n") for d in range(6) for p in range(1, 9) for b in range(pick.randint(0, 9))]
    layout = spark.createDataFrame(rows, "doc_id long, page_no int, blk_no int, text string")
    reply = RuleResponder(lambda p: F.to_json(F.array(F.struct(F.right(p, F.lit(9)).alias("question"), F.sha2(p, 256).alias("answer")))))
    for qa, ratio in ((True, 0.5), (False, 1.0)):
        runs = []
        for long in (False, True):
            conf = Config(output_dir=str(tmp_path / f"{qa}{long}"), max_block_size=60, min_block_size=5, enable_qa_filter=qa, extract_ratio=ratio)
            run = pipeline.process(spark, layout, reply, conf, long=long)
            runs.append((sorted(map(str, run.results.collect())), sorted(map(str, run.stats.collect())), [r.value for r in spark.read.text(conf.output_path).collect()]))
        assert runs[0] == runs[1] and len(runs[0][2]) > 5
    conf = Config(max_block_size=60, min_block_size=5)
    few = pipeline.surviving_long_blocks(layout, conf, segment_rows=3)
    assert sorted(few.collect()) == sorted(pipeline.surviving_long_blocks(layout, conf).collect())
