import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators.responders import RuleResponder
from dialoom.plans import pipeline
from dialoom.plans.config import Config
from dialoom.sources import documents, paged
from dialoom.sources.paged import Found, TextPages, dealt, listed, paged_source


TORN = "\xff"


def read(spark, path, **options):
    spark.dataSource.register(paged_source(TextPages, "paged_text"))
    return spark.read.format("paged_text").options(**options).load(str(path))


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    pages = [TORN if i % 100 == 7 else f"page {i} a\nb {i}" for i in range(1000)]
    (tmp_path / "big.txt").write_bytes("\f".join(pages).encode("latin-1"))
    for i in range(5):
        (tmp_path / f"s{i}.txt").write_text(f"x{i}\fy{i}")
    df = read(spark, tmp_path, splitBytes=2000)
    tasks = {r.p for r in df.where("path like '%big.txt'").select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) >= 5 and df.rdd.getNumPartitions() == len(tasks) + 1
    got = [(r.page_no, r.blk_no, r.text, r.error and "invalid start byte" in r.error) for r in df.where("path like '%big.txt'").sort("page_no", "blk_no").collect()]
    want = []
    for i, p in enumerate(pages):
        want += [(i + 1, 0, None, True)] if p == TORN else [(i + 1, k, t, None) for k, t in enumerate(p.split("\n"))]
    assert got == want
    assert {r[0] for r in df.select("page_count").distinct().collect()} == {1000, 2}
    # The same rows, whatever the split.
    whole = read(spark, tmp_path, splitBytes=1 << 30)
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(str, whole.drop("metadata").collect())) == sorted(map(str, df.drop("metadata").collect()))


def test_every_file_has_a_row(spark, tmp_path):
    for name, text in (("a.txt", "x\n\fy"), ("b.txt", "%PDF"), ("c.txt", ""), ("d.txt", "\f"), ("e.dat", "left out"), (".f.txt", "hidden")):
        (tmp_path / name).write_text(text)
    df = read(spark, tmp_path, pathGlobFilter="*.txt", splitBytes=1)
    got = sorted((os.path.basename(r.path), r.page_no, r.text, r.page_count, r.error) for r in df.collect())
    assert got == [("a.txt", 1, "", 2, None), ("a.txt", 1, "x", 2, None), ("a.txt", 2, "y", 2, None), ("b.txt", 0, None, None, "a PDF file, not its text"), ("c.txt", 0, None, 0, None), ("d.txt", 0, None, 2, None)]
    info = {os.path.basename(r.path): (r.page_count, r.file_size, r.is_pdf, r.metadata) for r in documents.file_info(df).collect()}
    assert info == {"a.txt": (2, 4, True, {"format": "text"}), "b.txt": (None, 4, None, None), "c.txt": (0, 0, True, {"format": "text"}), "d.txt": (2, 1, True, {"format": "text"})}
    run = pipeline.process(spark, df.withColumn("doc_id", F.element_at(F.split("path", "/"), -1)), RuleResponder(lambda p: F.lit(None).cast("string")), Config(output_dir=str(tmp_path / "out"), min_block_size=1))
    assert {r.doc_id: (r.total_blocks, r.pdf_pages, r.message) for r in run.stats.collect()} == {"a.txt": (1, 2, None), "b.txt": (0, 0, "a PDF file, not its text"), "c.txt": (0, 0, "No text blocks to process"), "d.txt": (0, 2, "No text blocks to process")}


def test_planning_lists_only(tmp_path):
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "none"), "*")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("12345")
    assert [(f.path, f.size) for f in listed(str(tmp_path / "x" / "a.txt"), "*")] == [(str(tmp_path / "x" / "a.txt"), 5)]
    assert [f.size for f in listed(f"file://{tmp_path}/x", "*.txt")] == [5] and listed(f"file:{tmp_path}/x", "*.pdf") == []
    files = [Found("a", 10, 0), Found("b", 95, 1), Found("c", 250, 2), Found("d", 0, 3), Found("e", 100, 4)]
    assert [[(f.path, k, n) for f, k, n in s.parts] for s in dealt(files, 100)] == [[("a", 0, 1)], [("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("b", 0, 1), ("d", 0, 1)], [("e", 0, 1)]]


def test_files_are_read_as_they_arrive(spark, tmp_path):
    spark.dataSource.register(paged_source(TextPages, "paged_text"))
    (tmp_path / "in").mkdir()

    def run():
        rows = spark.readStream.format("paged_text").option("splitBytes", 4).option("maxFilesPerTrigger", 2).load(str(tmp_path / "in"))
        query = rows.select("path", "page_no", "text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((os.path.basename(r.path), r.page_no, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"a{i}\fb{i}\fc{i}")
    want = [(f"f{i}.txt", n + 1, f"{c}{i}") for i in range(3) for n, c in enumerate("abc")]
    assert run() == want
    time.sleep(0.05)
    (tmp_path / "in" / "g.txt").write_text("new")
    assert run() == want + [("g.txt", 1, "new")]


class Sparing(io.BytesIO):
    """Never read whole."""

    def read(self, n=-1):
        assert 0 < n <= paged.STRETCH
        return super().read(n)


def test_a_large_text_is_read_by_stretches_and_a_bounded_number_of_times(monkeypatch):
    assert [len(dealt([Found("a", size, 0)], 1 << 16)) for size in (1 << 17, 1 << 22, 1 << 40)] == [2, paged.SHARES, paged.SHARES]
    pick = random.Random(4)
    for stretch in (1, 3, 8, 1000):
        monkeypatch.setattr(paged, "STRETCH", stretch)
        for _ in range(40):
            data = bytes(pick.choice(b"ab\n\f\f") for _ in range(pick.randint(1, 60)))
            doc, want = TextPages(Sparing(data)), [p.decode().split("\n") if p else [] for p in data.split(b"\f")]
            asked = [*range(doc.count), *pick.choices(range(doc.count), k=9)]
            assert doc.count == len(want) and [doc.page(i) for i in asked] == [want[i] for i in asked]
    assert TextPages(Sparing(b"")).count == 0
