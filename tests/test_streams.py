import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators import pairs, stats
from dialoom.operators.responders import RuleResponder
from dialoom.plans import pipeline
from dialoom.plans.config import Config
from dialoom.sources.documents import text_parts
from dialoom.streaming import blocks as streaming

CONF = Config(max_block_size=8, min_block_size=1)
#: A pair for most blocks, two for some, no reply or a bad one for the rest.
REPLY = RuleResponder(lambda p: F.when(p.contains("0"), None).when(p.contains("5"), "[]").otherwise(
    F.concat(F.lit('[{"question": "问：'), F.right(p, F.lit(2)), F.lit('", "answer": "'), F.right(p, F.lit(9)), F.when(p.contains("3"), F.lit('"}, {"question": "q", "answer": "abc"}]')).otherwise(F.lit('"}]')))))


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(streaming.STATE_STORE[0])
    spark.conf.set(*streaming.STATE_STORE)
    yield
    spark.conf.set(streaming.STATE_STORE[0], before)


def some_docs(spark, n=30):
    pick = random.Random(2)
    rows = [(i, None if i == 4 else "\n".join(f"line {pick.randint(0, 99)}" for _ in range(pick.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def arriving(spark, folder, frames):
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)


def test_merged_figures_equal_those_of_one_run(spark, tmp_path):
    docs = some_docs(spark)
    arriving(spark, tmp_path / "in", [docs.where(f"doc_id % 3 = {k}") for k in range(3)])
    stream = streaming.stream_documents(spark, str(tmp_path / "in"), per_trigger=1)
    out = str(tmp_path / "out")
    assert streaming.stream_pairs(stream, REPLY, CONF, out, str(tmp_path / "check")).awaitTermination(200)
    run = pipeline.plan(text_parts(docs), REPLY, CONF)
    rounded = lambda df: sorted(map(str, df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"}).collect()))
    assert len(list((tmp_path / "out" / "stats").glob("batch=*"))) == 3
    assert rounded(streaming.run_stats(spark, out)) == rounded(run.stats)
    assert rounded(streaming.quality(spark, out)) == rounded(stats.extraction_quality(run.records, docs))
    assert run.records.count() > 20 and run.results.where("not success").count() > 5
    assert spark.read.parquet(f"{out}/errors").count() == run.results.where("not success").count()


def test_partial_figures_merge_in_any_grouping(spark):
    results = pipeline.plan(text_parts(some_docs(spark)), REPLY, CONF).results.withColumn("batch", F.col("block_idx") % 3)
    partials = [stats.partial_stats(results.where(f"batch = {k}")) for k in range(3)]
    both = stats.merged_stats(partials[0].unionByName(partials[2]))
    want = sorted(map(str, stats.run_stats(results).collect()))
    assert sorted(map(str, stats.finished_stats(stats.merged_stats(both.unionByName(partials[1]))).collect())) == want
    assert sorted(map(str, stats.finished_stats(stats.merged_stats(partials[0].limit(0))).collect())) == []


def test_pair_numbers_run_on_over_batches_and_restarts(spark, tmp_path, state_store):
    records = pipeline.plan(text_parts(some_docs(spark)), REPLY, CONF).records
    records = records.withColumn("doc_id", F.when(F.col("doc_id") == 9, None).otherwise(F.col("doc_id")))
    want = sorted(map(str, pairs.number_pairs(records).collect()))
    steps = [records.where(c) for c in ("block_idx < 2", "block_idx in (2, 3)", "block_idx = 4", "block_idx > 4")]

    def go_on():
        rows = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = streaming.number_stream(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
        return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*records.columns, "pair_no").collect()))

    arriving(spark, tmp_path / "in", steps[:2])
    first = go_on()
    assert set(first) < set(want) and len(first) == steps[0].count() + steps[1].count()
    arriving(spark, tmp_path / "in", steps[2:])  # another query on the same checkpoint: a restart
    assert go_on() == want


def test_records_as_a_stream(spark, tmp_path):
    docs = some_docs(spark)
    arriving(spark, tmp_path / "in", [docs])
    conf = Config(max_block_size=8, min_block_size=1, extract_ratio=0.5)
    rows = streaming.stream_records(streaming.stream_documents(spark, str(tmp_path / "in")), REPLY, conf)
    assert rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)
    want = pipeline.plan(text_parts(docs), REPLY, conf).records
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect())) and want.count() > 0


def test_streamed_pairs_are_parsed_once(spark, monkeypatch):
    from dialoom.plans import catalog, fixtures

    given, seen, tables = fixtures.responses, spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"

    def note(reply):
        seen.add(1)
        return reply

    monkeypatch.setattr(fixtures, "responses", lambda *of: given(*of).withColumn("response", F.udf(note, "string").asNondeterministic()("response")))
    found = catalog.stream_pair_numbers(spark, tables)
    assert seen.value == given(spark, tables).count() > 0
    want = pairs.number_pairs(pairs.qa_records(pairs.block_results(given(spark, tables)))).select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
