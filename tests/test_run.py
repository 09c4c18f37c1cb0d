import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from dialoom.operators.responders import HttpResponder, ReplayResponder, RuleResponder, prompt_key
from dialoom.plans import cli, config, logs, pipeline
from dialoom.plans.config import Config
from dialoom.sources import documents, jsonl
from dialoom.streaming import blocks as streaming

PARTS = [(1, ["网友：什么？" * 30, "段永平：这样。" * 30]), (2, ["short"]), (3, [])]


@pytest.fixture
def server():
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _send(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._send({"models": [{"name": "m"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            self._send({"message": {"content": '[{"question": "网友：q", "answer": "a"}]'}} if "什么" in body["messages"][0]["content"] else {"odd": 1})

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", calls
    own.shutdown()


def parts(spark):
    return spark.createDataFrame(PARTS, "doc_id long, parts array<string>")


def test_each_prompt_is_sent_once(spark, server, tmp_path):
    host, calls = server
    run = pipeline.plan(parts(spark), HttpResponder("m", host), Config(min_block_size=1), str(tmp_path / "r"))
    assert [(r.doc_id, r.question) for r in run.records.collect()] == [(1, "q")]
    assert run.results.count() == 2 and run.stats.count() == 3 and run.results.where("not success").count() == 1
    assert len(calls) == 2 and calls[0]["options"]["temperature"] == 0.1


def test_responder_admin(server):
    host, _ = server
    asked = HttpResponder("m", host)
    assert asked.connected() and asked.available() and asked.model_info()["name"] == "m"
    assert asked.with_model("x") == (asked, False) and HttpResponder("y", host).with_model("m")[1]
    gone = HttpResponder("m", "http://127.0.0.1:9", timeout=1)
    assert not gone.connected() and not gone.available() and gone.ask("x") is None and gone.model_info() is None and not gone.pull()


def test_replay_and_process(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(PARTS[0][1])], "doc_id long, page_no int, blk_no int, text string")
    conf = Config(output_dir=str(tmp_path), min_block_size=10)
    asked = pipeline.prompts(pipeline.surviving_blocks(documents.paragraph_arrays(lines), conf))
    known = asked.select(prompt_key(F.col("prompt")).alias("prompt_key"), F.lit('{"question": "问：甲", "answer": "乙"}').alias("response"))
    pipeline.process(spark, lines, ReplayResponder(known), conf)
    got = jsonl.load(spark, conf.output_path).first()
    assert (got.item.question, got.item.answer) == ("甲", "乙") and got.item.source_text.startswith("网友")
    assert spark.read.text(str(tmp_path / "extraction_success.log")).where("value rlike '^[0-9-]{10} [0-9:]{8},[0-9]{3} - INFO - QA_PAIR_START$'").count() == 1


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    assert jsonl.count_lines(spark, path) == 0 and jsonl.file_size(spark, path) == 0 and jsonl.backup(spark, path) is None
    (tmp_path / "x.jsonl").write_text('{"question": "q"}\n\n [1]\n5\nbad\n', encoding="utf-8")
    rows = jsonl.load(spark, path).collect()
    assert sorted((r.value, r.valid, r.item is not None) for r in rows) == [("5", True, False), ("[1]", True, False), ("bad", False, False), ('{"question": "q"}', True, True)]
    assert sorted(map(str, jsonl.iterate(spark, path))) == ["5", "[1]", "{'question': 'q'}"]
    assert jsonl.count_lines(spark, path) == 4 and jsonl.backup(spark, path) == path + ".bak" and jsonl.file_size(spark, path) > 0
    (tmp_path / "a.tmp").write_text("")
    assert jsonl.cleanup(spark, str(tmp_path)) == 1 and jsonl.cleanup(spark, str(tmp_path / "none")) == 0
    out = str(tmp_path / "out")
    jsonl.save(spark.createDataFrame([("中", None)], "a string, b string"), out)
    jsonl.save(spark.createDataFrame([("x", "y")], "a string, b string"), out, append=True)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a":"x","b":"y"}', '{"a":"中","b":null}']


def test_pdf(spark, tmp_path):
    def reader(content):
        if content == b"bad":
            raise ValueError("no")
        return [[content.decode() + "\n1 ", "  "], RuntimeError("page")], False

    for name, data in (("a.pdf", b"A"), ("b.pdf", b"bad")):
        (tmp_path / name).write_bytes(data)
    rows = documents.read_pdf(spark, str(tmp_path), reader)
    assert [(r.page_no, r.text) for r in documents.layout_paragraphs(rows, "path").collect()] == [(1, "A 1")]
    assert rows.where("error is not null").count() == 2
    assert {r.path[-5:]: (r.page_count, r.file_size) for r in documents.pdf_info(spark, str(tmp_path), rows).collect()} == {"a.pdf": (2, 1), "b.pdf": (None, 3)}
    assert documents.page_text(rows, "path").first().page_text == "A\n1   "


def test_every_pdf_has_its_row_of_figures(spark, tmp_path, capsys):
    def reader(content):
        if content == b"bad":
            raise ValueError("no such luck")
        return ([[content.decode() * 200]] if content == b"A" else [[], [" \n"]] if content == b"blank" else []), False, {"title": content.decode()}

    (tmp_path / "in").mkdir()
    for name, data in (("a", b"A"), ("b", b"bad"), ("c", b"blank"), ("d", b"nothing")):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(data)
    blocks = documents.read_pdf(spark, str(tmp_path / "in"), reader)
    info = {r.path[-5:]: r for r in documents.pdf_info(spark, str(tmp_path / "in"), blocks).collect()}
    assert info["a.pdf"].metadata == {"title": "A"} and info["b.pdf"].metadata is None and info["d.pdf"].page_count == 0
    answer = RuleResponder(lambda p: F.lit('{"question": "q", "answer": "a"}'))
    run = pipeline.process(spark, blocks.withColumn("doc_id", F.substring("path", -5, 5)), answer, Config(output_dir=str(tmp_path / "out")))
    rows = {r.doc_id: (r.success, r.message, r.pdf_pages) for r in run.stats.collect()}
    assert rows == {"a.pdf": (True, None, 1), "b.pdf": (False, "no such luck", 0), "c.pdf": (False, "No text blocks to process", 2), "d.pdf": (False, "No text blocks to process", 0)}
    assert cli.finish(run.stats.orderBy("doc_id").collect(), "x") == 1 and "Failed: no such luck" in capsys.readouterr().out
    assert cli.finish([], "x") == 1


def test_config(tmp_path):
    base = Config()
    assert (base.max_block_size, base.min_block_size, base.extract_ratio, base.temperature, base.enable_qa_filter, len(base.known_prefixes)) == (1500, 100, 1.0, 0.1, False, 11)
    path = str(tmp_path / "d" / "c.yaml")
    config.save_config(Config(max_block_size=7, known_prefixes=["甲"]), path)
    assert config.load_config(path, {}) == Config(max_block_size=7, known_prefixes=["甲"])
    env = {"MAX_BLOCK_SIZE": "9", "MODEL_TEMPERATURE": "0.5", "ENABLE_QA_FILTER": "Yes", "OLLAMA_MODEL": ""}
    assert config.load_config(path, env) == Config(max_block_size=9, temperature=0.5, enable_qa_filter=True, model_name="", known_prefixes=["甲"])
    assert config.load_config(str(tmp_path / "none"), {}) == base
    (tmp_path / "bad.yaml").write_text("a: [unclosed\nb: : :")
    assert config.load_config(str(tmp_path / "bad.yaml"), {}) == base
    (tmp_path / "odd.yaml").write_text("unknown: 1\nlog_level: DEBUG\n")
    assert config.load_config(str(tmp_path / "odd.yaml"), {}) == Config(log_level="DEBUG")


def test_cli(tmp_path, capsys, monkeypatch):
    def merged(*argv, env=None):
        return cli.merge(cli.parser().parse_args(list(argv)), env or {})

    got = merged("x.pdf", "-m", "big", "--sample", "0", "--max-block-size", "0", "-t", "0", "--enable-qa-filter", "--disable-qa-filter", "-q", "-v")
    assert got == Config(pdf_filename="x.pdf", model_name="big", extract_ratio=0.0, temperature=0.0, log_level="WARNING")
    assert merged(env={"OLLAMA_HOST": "h"}).ollama_host == "h" and merged("--host", "i", env={"OLLAMA_HOST": "h"}).ollama_host == "i"
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--create-config"]) == 0 and (tmp_path / "config" / "config.yaml").exists()
    monkeypatch.setenv("OLLAMA_HOST", "http://127.0.0.1:9")
    assert cli.main(["missing.pdf", "--validate"]) == 1 and "not found" in capsys.readouterr().out
    assert Config(output_filename="/a/b").output_path == "/a/b" and Config().output_path == "output/output_final_qa.jsonl"


def test_logger_starts_its_file_anew(tmp_path):
    path = str(tmp_path / "logs" / "main.log")
    for _ in range(2):
        logs.logger("own", path=path).info("line")
    assert len(open(path, encoding="utf-8").readlines()) == 1


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "网友：什么？" * 30 + "\n" + "段永平：这样。" * 30), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    asked = RuleResponder(lambda p: F.lit('{"question": "q", "answer": "a"}'))
    query = streaming.stream_pairs(streaming.stream_documents(spark, str(tmp_path / "in")), asked, Config(), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert [(r.doc_id, r.question) for r in spark.read.parquet(str(tmp_path / "out" / "pairs")).collect()] == [(1, "q")]
    assert streaming.stream_blocks(docs, Config(enable_qa_filter=True)).count() == 1


def test_entry_runs_without_the_llm_folders(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "dialoom", tmp_path / "dialoom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    for empty_folder_is_left in (False, True):
        if empty_folder_is_left:
            (tmp_path / "dialoom" / "llm").mkdir()
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_examples():
    import importlib.util
    import pathlib

    path = pathlib.Path(__file__).resolve().parents[1] / "examples" / "extract.py"
    spec = importlib.util.spec_from_file_location("extract", path)
    example = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(example)
    made = {name: way("x.pdf") for name, way in example.WAYS.items()}
    assert all(c.pdf_filename == "x.pdf" for c in made.values())
    assert (made["basic"].extract_ratio, made["file"].enable_qa_filter, made["custom"].max_block_size, len(made["custom"].known_prefixes)) == (0.1, True, 2000, 15)
    assert example.run(Config(ollama_host="http://127.0.0.1:9")) == 1


def test_a_file_that_breaks_off(spark, tmp_path):
    import gzip

    text = "".join(f'{{"question": "q{i}"}}\n' + ("\n" if i % 100 == 0 else "bad\n" if i % 100 == 1 else "") for i in range(20_000))
    (tmp_path / "whole").mkdir()
    (tmp_path / "cut").mkdir()
    packed = gzip.compress(text.encode())
    (tmp_path / "whole" / "a.jsonl.gz").write_bytes(packed)
    (tmp_path / "cut" / "a.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    rows, counts = jsonl.load_whole(spark, str(tmp_path / "whole"))
    assert counts == {"lines": 20_400, "blank": 200, "bad": 200} and rows.count() == 20_200 and rows.where("valid").count() == 20_000
    rows.unpersist()
    none, zeros = jsonl.load_whole(spark, str(tmp_path / "cut"))
    assert none.count() == 0 and set(zeros.values()) == {0} and none.columns == rows.columns
    some = [x["question"] for x in jsonl.iterate(spark, str(tmp_path / "cut"))]
    assert some == [f"q{i}" for i in range(len(some))] and 0 < len(some) < 20_000
    assert jsonl.load_whole(spark, str(tmp_path / "missing"))[0].count() == 0


def test_logs_are_in_order_over_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("doc_id"), F.lit("e").alias("error")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    jsonl.save_log(rows, str(tmp_path / "log"), "BLOCK", "ERROR", order=["doc_id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "log").glob("part-*"))
    lines = [x for f in files for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(files) > 1 and [x for x in lines if x.startswith("doc_id")] == [f"doc_id: {i}" for i in range(5000)]
    assert lines[0].endswith("ERROR - BLOCK_START") and lines[3] == "BLOCK_END" and len(lines) == 20_000


def test_settings_are_echoed(spark):
    run = pipeline.plan(parts(spark), RuleResponder(lambda p: F.lit(None).cast("string")), Config(max_block_size=7, model_name="m"))
    assert run.config_used == {"model_name": "m", "max_block_size": 7, "min_block_size": 100, "extract_ratio": 1.0, "enable_qa_filter": False, "temperature": 0.1}
