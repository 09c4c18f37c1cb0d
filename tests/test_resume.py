import json
import random
import threading
import time
from dataclasses import dataclass

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.operators.ledger import Ledger, ask_key
from dialoom.operators.responders import HttpResponder, RuleResponder
from dialoom.plans import pipeline
from dialoom.plans.config import Config
from dialoom.sources import jsonl

CONF = Config(max_block_size=20, min_block_size=1)


def parts(spark, docs=6, n=10):
    return spark.createDataFrame([(d, [f"问题 {d} {i:02d} " + "x" * 12 for i in range(n)]) for d in range(docs)], "doc_id long, parts array<string>")


def layout(spark, docs=6, n=10):
    return spark.createDataFrame([(d, 1, i, f"问题 {d} {i:02d} " + "x" * 12) for d in range(docs) for i in range(n)], "doc_id long, page_no int, blk_no int, text string")


@dataclass(frozen=True)
class Dying:
    """Answers so many chunks, then dies, as a driver would."""

    inner: object
    chunks: list

    def respond(self, df: DataFrame) -> DataFrame:
        if not self.chunks:
            raise KeyboardInterrupt
        self.chunks.pop()
        return self.inner.respond(df)


@pytest.fixture
def server():
    """A model that says which prompt it was asked, fails where told to, and counts."""
    import http.server

    calls, failing, gauge = [], set(), {"now": 0, "most": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"].split("\n")[-1]
            gauge["now"] += 1
            gauge["most"] = max(gauge["most"], gauge["now"])
            time.sleep(gauge.get("pause", 0))
            gauge["now"] -= 1
            calls.append(prompt)
            good = not any(x in prompt for x in failing)
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": json.dumps([{"question": prompt, "answer": f"a {prompt}"}])}}).encode())

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    own.daemon_threads = True
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", calls, failing, gauge
    own.shutdown()


def output(spark, conf):
    return [json.loads(r.value) for r in jsonl.lines(spark, conf.output_path).collect()]


def test_a_run_that_died_is_resumed_without_sending_twice(spark, server, tmp_path):
    host, calls, _, _ = server
    asked = HttpResponder("m", host)
    whole, cut = (Config(max_block_size=20, min_block_size=1, output_dir=str(tmp_path / d)) for d in ("whole", "cut"))
    pipeline.process(spark, layout(spark), asked, whole, chunk_rows=10)
    assert len(calls) == len(set(calls)) == 60
    want = output(spark, whole)
    calls.clear()
    with pytest.raises(KeyboardInterrupt):
        pipeline.process(spark, layout(spark), Dying(asked, [1, 2, 3]), cut, chunk_rows=10)
    sent = len(calls)
    left = output(spark, cut)
    # What is left is a valid prefix: all pairs of the prompts that were sent, which lead the run.
    assert 0 < sent < 60 and sorted(x["question"] for x in left) == sorted(x["question"] for x in want)[:sent]
    run = pipeline.process(spark, layout(spark), asked, cut, chunk_rows=7, resume=True)
    assert len(calls) == 60 and len(set(calls)) == 60
    assert output(spark, cut) == want and run.results.count() == 60
    # Nothing is left to send; without `resume` all is sent again.
    pipeline.process(spark, layout(spark), asked, cut, resume=True)
    assert len(calls) == 60 and output(spark, cut) == want
    pipeline.process(spark, layout(spark), asked, cut)
    assert len(calls) == 120 and output(spark, cut) == want


def test_failed_calls_are_sent_again_when_told_to(spark, server, tmp_path):
    host, calls, failing, _ = server
    failing.add(" 03 ")
    asked = HttpResponder("m", host)
    path = str(tmp_path / "r")
    first = pipeline.plan(parts(spark), asked, CONF, path, chunk_rows=25)
    assert first.results.where("error = 'LLM call failed'").count() == 6
    failing.clear()
    assert pipeline.plan(parts(spark), asked, CONF, path, resume=True).results.where("not success").count() == 6 and len(calls) == 60
    again = pipeline.plan(parts(spark), asked, CONF, path, resume=True, retry_failed=True)
    assert again.results.where("success").count() == 60 and len(calls) == 66


def test_other_prompts_are_other_questions(spark, server, tmp_path):
    host, calls, _, _ = server
    path = str(tmp_path / "r")
    pipeline.plan(parts(spark, 2), HttpResponder("m", host), CONF, path)
    more = parts(spark, 3).withColumn("parts", F.when(F.col("doc_id") == 1, F.transform("parts", lambda p: F.replace(p, F.lit("05"), F.lit("95")))).otherwise(F.col("parts")))
    run = pipeline.plan(more, HttpResponder("m", host), CONF, path, resume=True)
    assert len(calls) == 20 + 10 + 1 and run.records.count() == 30 and run.records.where("answer like '% 95 %'").count() == 1


def test_chunks_that_were_cut_off_do_not_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    pick = random.Random(1)
    rows = [(pick.choice([None, 1, 2]), i, f"p{i}") for i in range(40)]
    asks = spark.createDataFrame(rows * 2, "doc_id int, block_idx int, prompt string").withColumn("ask_key", ask_key(F.col("doc_id"), F.col("block_idx"), F.col("prompt")))
    upper = RuleResponder(lambda p: F.upper(p))
    ledger.answer(asks, upper, ["doc_id", "block_idx"], chunk_rows=10, stop_after=2)
    assert ledger.chunks() == [0, 1]
    (tmp_path / "l" / "chunk=000001" / "_SUCCESS").unlink()
    (tmp_path / "l" / "chunk=000002").mkdir()
    assert ledger.chunks() == [0]
    done = ledger.answer(asks, upper, ["doc_id", "block_idx"], chunk_rows=10)
    assert sorted((r.prompt, r.response) for r in done.collect()) == sorted((p, p.upper()) for _, _, p in rows * 2)
    assert ledger.replies().count() == 40 and ledger.answer(asks.limit(0), upper, ["doc_id"]).count() == 0


def test_calls_are_made_side_by_side_and_in_order(spark, server):
    host, calls, failing, gauge = server
    gauge["pause"] = 0.1
    failing.add("7")
    prompts = [None if i == 20 else f"p{i:02d}" for i in range(64)]
    df = spark.createDataFrame(list(enumerate(prompts)), "i int, prompt string").coalesce(1)
    asked = HttpResponder("m", host, in_flight=8)
    asked.respond(df.limit(1)).collect()
    calls.clear()
    gauge["most"] = 0
    began = time.time()
    rows = asked.respond(df).collect()  # a sort would ask twice: it samples its input first
    took = time.time() - began
    assert [r.prompt for r in rows] == prompts and sorted(calls) == sorted(p for p in prompts if p)
    assert all((r.response is None) == (r.prompt is None or "7" in r.prompt) and (r.response is None or r.prompt in r.response) for r in rows)
    assert 2 < gauge["most"] <= 8 and took < 5  # 63 calls one by one take 6.3 seconds


def test_each_host_has_its_own_places(server):
    host, calls, _, gauge = server
    gauge["pause"] = 0.05
    both = HttpResponder("m", host, in_flight=1, more_hosts=(host.replace("127.0.0.1", "localhost"),))
    assert [("p" in r) for r in both.ask_all(f"p{i}" for i in range(10))] == [True] * 10
    assert gauge["most"] == 2 and len(calls) == 10
    # A call that hangs holds back neither the other host nor what is already done.
    slow = HttpResponder("m", "http://127.0.0.1:9", in_flight=1, more_hosts=(host,), timeout=1)
    got = list(slow.ask_all(f"p{i}" for i in range(6)))
    assert len(got) == 6 and any(got)


def test_a_window_is_bounded():
    from dialoom.operators.responders import in_order

    taken = []

    def items():
        for i in range(100):
            taken.append(i)
            yield i

    gate = threading.Event()
    out = in_order(items(), lambda i: (gate.wait(5) if i == 0 else None, i)[1], 3)
    threading.Timer(0.3, gate.set).start()
    assert next(out) == 0 and len(taken) <= 12 and list(out) == list(range(1, 100))
