import json
import random
import re

from pyspark.sql import functions as F

from dialoom.functions import replies
from dialoom.functions.replies import as_question, as_text, pairs_of, parse, strict_json, strict_pairs, valid
from dialoom.operators import pairs, stats

OK = '{"question": "q", "answer": "a"}'


def found(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", replies.pairs_of(F.col("t")).alias("p")).orderBy("i").collect()
    return [None if r.p is None else [(x.question, x.answer) for x in r.p] for r in rows]


def test_pairs_of_replies(spark):
    one, two = [("q", "a")], [("q", "a")] * 2
    cases = {
        f"x ```json\n[{OK}]\n``` y": one, f"```json {OK} ``` and ```json [{OK}]```": two, f"[{OK}, 7, [{OK}]]": one, OK: one, f"{OK}\n{OK}": two, f"so {OK} stray }} {OK}": one,
        f"```\n{OK}\n```": one, "[[" + OK + "]]": [], "5": [], "": [], "  ": [], "[{": [], '{"question": "q", "answer": " "}': [], '{"question": "q"}': [], "{'question': 'q', 'answer': 'a'}": [],
        '{"question": "q", "answer": 0}': [], '{"question": 1, "answer": ["x"]}': [("1", '["x"]')], '{"question": true, "answer": {"k": null}}': [("True", '{"k": null}')], '{"question": ["é"], "answer": 1.5}': [("['é']", "1.5")], '{"question": "q", "answer": NaN}': [("q", "NaN")], '{"question": "x", "question": "q", "answer": "a"}': one,
    }
    assert found(spark, *cases, None) == [*cases.values(), None]


def test_brace_scan_equals_a_plain_loop(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choice("{}ab\n") for _ in range(pick.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in replies.brace_objects(df, "t", ["i"]).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append(r.object)
    assert got == {i: o for i, t in enumerate(texts) if (o := list(replies.scan_objects(t)))}


def results(spark):
    rows = [(1, 0, "b0", json.dumps([{"question": "网友：q1", "answer": "long answer!"}, {"question": "q1", "answer": "x"}])), (1, 1, "b1", None), (1, 2, "b2", "none"), (2, 0, "c0", OK)]
    return pairs.block_results(spark.createDataFrame(rows, "doc_id long, block_idx long, block string, response string"))


def test_block_results_and_logs(spark):
    got = {(r.doc_id, r.block_idx): (r.success, r.error, r.qa_count) for r in results(spark).collect()}
    assert got == {(1, 0): (True, None, 2), (1, 1): (False, pairs.NO_REPLY, 0), (1, 2): (False, pairs.NO_PAIRS, 0), (2, 0): (True, None, 1)}
    assert sorted((r.doc_id, r.pair_no, r.question) for r in pairs.success_log(results(spark)).collect()) == [(1, 1, "q1"), (1, 2, "q1"), (2, 1, "q")]
    assert sorted(r.block_no for r in pairs.error_log(results(spark)).collect()) == [2, 3]


def test_stats(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    one, two, none = stats.run_stats(results(spark), docs).orderBy("doc_id").collect()
    assert (one.total_blocks, one.successful_blocks, one.failed_blocks, one.qa_pairs_extracted, one.avg_qa_per_block, one.max_answer_length, one.avg_question_length) == (3, 1, 2, 2, 2.0, 12, 2.0)
    assert round(one.success_rate, 6) == 0.333333 and two.success and one.message is None
    assert (none.total_blocks, none.success_rate, none.success, none.avg_answer_length) == (0, 0.0, False, None) and none.message
    q = {r.doc_id: r for r in stats.extraction_quality(pairs.qa_records(results(spark)), docs).collect()}
    assert q[1].has_duplicates and q[1].quality_score == 0.2 and q[2].quality_score == 0.4 and (q[3].total_pairs, q[3].quality_score) == (0, 0.0)


def test_strict_pairs_takes_replies_by_content(spark, monkeypatch):
    from dialoom.plans import catalog

    texts = [OK, f"[{OK}, {OK}]", "no json", None, f"{OK}\n{OK}", f"[{OK}, 7]", '{"question": 1, "answer": "a"}', f" {OK} "]
    given = spark.createDataFrame([(8 * i, 0, t) for i, t in enumerate(texts)], "doc_id long, block_idx long, response string")
    monkeypatch.setattr(catalog.fixtures, "responses", lambda spark, sf_dir: given)
    got = sorted((r.doc_id, r.pair_idx, r.question, r.answer) for r in catalog.strict_pairs(spark, "").collect())
    assert got == [(0, 0, "q", "a"), (8, 0, "q", "a"), (8, 1, "q", "a"), (56, 0, "q", "a")]


def hostile(pick):
    """A reply that is strict, nearly strict, or broken in one place."""
    text = lambda: "".join(pick.choice(['a', '"', "\\", "é", "\n", "问", "{", "}", "[", "]", ",", ":", " ", " ", "question", "😀", "\x00", "\x01", "x" * 40]) for _ in range(pick.randint(0, 6)))
    value = lambda: pick.choice([text(), text(), text(), text(), 7, None, True, [], {"question": "q"}, float("nan")]) if pick.random() < 0.3 else text()
    item = lambda: dict(pick.sample([("question", value()), ("answer", value()), ("other", value())], k=pick.choice([2, 2, 2, 3, 1]))) if pick.random() < 0.3 else {"question": text(), "answer": text()}
    shape = pick.choice([item(), [item() for _ in range(pick.randint(0, 4))], [item(), 7], []])
    out = json.dumps(shape, ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, None, 1]), separators=pick.choice([None, (",", ":"), (" , ", " : ")]))
    for _ in range(pick.choice([0, 0, 0, 1, 2])):
        at = pick.randint(0, len(out))
        out = pick.choice([
            out[:at] + pick.choice(['"', "\\", ",", "{", "}", "[", "]", "\t", "\x03", "\\u00e9", "\\ud800", "\\q", '"question":"x"', ",{}", "null", "﻿", "```json", "'"]) + out[at:],
            out[:at] + out[at + 1 :], out[:at], out + out, " " + out + "　\n", '{"question": "a", "question": "b", "answer": "c"}', out + ",{}"])
    return out


def test_strict_replies_need_no_python(spark):
    pick = random.Random(11)
    replies = [hostile(pick) for _ in range(4000)] + [None, "", "[]", '{"question": "q", "answer": "a"}', '[{"question":"q","answer":"a"},]', '[,{"question":"q","answer":"a"}]', '[{"question":"q","answer":"a"}],{"question":"q","answer":"a"}', '[{"question":"q","answer":"a"}{"question":"q","answer":"a"}]', '{"question" "q":"x", "answer": "a"}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    plan = df.where(strict_json(F.col("reply"))).select(strict_pairs(F.col("reply")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    both = df.select("i", strict_json(F.col("reply")).alias("strict"), strict_pairs(F.col("reply")).alias("fast"), pairs_of(F.col("reply")).alias("found")).collect()
    sure = 0
    for r in both:
        reply = replies[r.i]
        fences = re.findall(r"```json\s*(.*?)\s*```", reply or "", re.S) or [reply]
        want = None if reply is None else [(as_question(x["question"]), as_text(x["answer"])) for part in fences for x in parse(part) if valid(x)]
        got = None if r.found is None else [(p.question, p.answer) for p in r.found]
        if want is not None:
            want = [tuple(re.sub("[\ud800-\udfff]", "\ufffd", x) for x in p) for p in want]
        assert got == want, reply
        if r.strict:
            sure += 1
            assert [(p.question, p.answer) for p in r.fast] == want, reply
            json.loads(reply.strip())
    assert sure > 1000


def test_long_strict_replies(spark):
    many = json.dumps([{"question": "q\n" * 50, "answer": "a\\\"" * 20}] * 20_000)
    one = json.dumps({"answer": "\téx" * 500_000, "question": "q"})
    rows = spark.createDataFrame([(many,), (one,)], "reply string").select(strict_json(F.col("reply")), F.size(strict_pairs(F.col("reply")))).collect()
    assert [tuple(r) for r in rows] == [(True, 20_000), (True, 1)]


def test_replies_are_parsed_once(spark):
    from dialoom.operators import pairs

    good = '{"question": "q", "answer": "a", "more": 1}'
    rows = spark.createDataFrame([(i, 0, "b", None if i == 3 else f"so {good}" * (i % 3)) for i in range(600)], "doc_id long, block_idx long, block string, response string")
    records = pairs.qa_records(pairs.block_results(rows))
    assert records._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.pair_idx) for r in records.collect()) == sorted((i, k) for i in range(600) if i != 3 for k in range(i % 3))
