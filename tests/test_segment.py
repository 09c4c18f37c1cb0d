import random

import pytest

from dialoom.operators import segment


def model(parts, most, least):
    """Greedy blocks by a plain loop."""
    out, cur, size = [], [], 0
    for p in parts:
        if cur and size + len(p) > most:
            out.append(cur)
            cur, size = [], 0
        cur.append(p)
        size += len(p)
    out += [cur] if cur else []
    return [(i, t) for i, t in enumerate("\n\n".join(b) for b in out) if len(t) >= least]


def test_blocks_equal_a_plain_loop(spark):
    pick = random.Random(2)
    docs = [(i, ["x" * pick.randint(1, 40) for _ in range(pick.randint(0, 12))]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, parts array<string>")
    for most, least in ((50, 10), (1, 1), (1000, 5), (30, 45)):
        got = {}
        for r in segment.blocks(df, "parts", ["doc_id"], max_size=most, min_size=least).collect():
            got.setdefault(r.doc_id, []).append((r.seg_no, r.block))
        assert got == {i: m for i, p in docs if (m := model(p, most, least))}


def test_long_documents(spark):
    df = spark.createDataFrame([(1, ["ab"] * 20_000)], "doc_id long, parts array<string>")
    assert segment.blocks(df, "parts", ["doc_id"], max_size=100, min_size=1).count() == 400


@pytest.mark.parametrize(("ratio", "n"), [(1.0, 10), (1.5, 10), (0.5, 5), (0.29, 2), (0.1, 1), (0.01, 1), (0.0, 0), (-1.0, 0)])
def test_sample_is_a_prefix(spark, ratio, n):
    df = spark.createDataFrame([(1, i) for i in range(10)], "doc_id long, seg_no long")
    assert sorted(r.seg_no for r in segment.sample_prefix(df, ratio).collect()) == list(range(n))


def test_index_is_dense(spark):
    df = spark.createDataFrame([(1, 3), (1, 7), (2, 5)], "doc_id long, seg_no long")
    assert sorted((r.doc_id, r.seg_no, r.block_idx) for r in segment.index_blocks(df).collect()) == [(1, 3, 0), (1, 7, 1), (2, 5, 0)]


def test_choosing_in_the_row_equals_choosing_rows(spark):
    pick = random.Random(4)
    docs = [(i, [pick.choice(["网友：", "段永平：", "听说 ", ""]) + "x" * pick.randint(1, 40) for _ in range(pick.randint(0, 30))]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, parts array<string>")
    for qa, ratio in ((True, 0.5), (False, 0.34), (True, 1.0), (True, 2.0), (False, 0.0)):
        rows = segment.blocks(df, "parts", ["doc_id"], max_size=60, min_size=10)
        want = segment.index_blocks(segment.sample_prefix(segment.filter_qa(rows) if qa else rows, ratio))
        got = segment.chosen_blocks(df, "parts", ["doc_id"], max_size=60, min_size=10, qa_only=qa, ratio=ratio)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_time_grows_with_the_paragraphs(spark):
    import time

    from pyspark.sql import functions as F

    from dialoom.functions.replies import brace_objects

    for n in (1000, 200_000):  # the first one warms up
        row = spark.range(1).select(F.array_repeat(F.lit("abc"), n).alias("parts"), F.repeat(F.lit("a{}"), n).alias("text"))
        began = time.time()
        assert segment.blocks(row, "parts", [], max_size=3, min_size=1).agg(F.count("*"), F.max("seg_no")).first()[:] == (n, n - 1)
        middle = time.time()
        assert brace_objects(row, "text", []).agg(F.count("*"), F.max("pos"), F.max("object")).first()[:] == (n, 3 * n - 1, "{}")
        took = middle - began, time.time() - middle
    assert took[0] < 30 and took[1] < 60  # quadratic folds took some 1000 and 2700
