"""Columns of the input that have the names an operator gives: theirs stay as they are, the new ones get underscores."""

from pyspark.sql import functions as F

from dialoom.llm import chat, decontaminate, pii, quality, toxicity

TEXT = "mail a.b@example.org or else " + " ".join(f"w{i}" for i in range(60))


def docs(spark, *names):
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([TEXT, None, "", TEXT])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))


def kept(made, before):
    own = lambda df: sorted(map(str, df.select(*[F.col(f"`{c}`") for c in before.columns]).collect()))
    assert own(made) == own(before) and len(set(made.columns)) == len(made.columns)
    return [c for c in made.columns if c not in before.columns]


def test_spans(spark):
    before = docs(spark, "pii", "masked", "_pii")
    made = pii.find_pii(before)
    assert kept(made, before) == ["__pii"] and [len(r["__pii"]) for r in made.sort("doc_id").collect()] == [1, 0, 0, 1]
    assert pii.mask_pii(before).columns == before.columns and [r.text and r.text[:12] for r in pii.mask_pii(before).sort("doc_id").collect()] == ["mail [email]", None, "", "mail [email]"]
    assert kept(pii.find_pii(before.limit(0)), before.limit(0)) == ["__pii"]


def test_scores(spark):
    before = docs(spark, "toxicity", "score", "passages")
    made = toxicity.score(before, toxicity.Model({}))
    assert kept(made, before) == ["_toxicity"] and made.select("_toxicity.score").distinct().count() == 1
    assert toxicity.drop_toxic(before, spark.createDataFrame([], "doc_id long, toxic int")).columns == before.columns


def test_verdicts(spark):
    before = docs(spark, "m", "kept", "host", "bad_host", "source", "base_failed")
    made = quality.judge(before, keep=("doc_id", "m", "kept", "host", "bad_host", "base_failed"))
    assert made.columns == ["doc_id", "m", "kept", "host", "bad_host", "base_failed", "_m", "_base_failed", "_kept"]
    assert [(r.m, r.kept, r["_m"].n_words, r["_base_failed"]) for r in made.sort("doc_id").collect()] == [("m0", "kept0", 64, False), ("m1", "kept1", 0, True), ("m2", "kept2", 0, True), ("m3", "kept3", 64, False)]


def test_matches(spark):
    before = docs(spark, "matched", "cut", "items")
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "or else")], "item_id long, text string")
    for chars in (10_000, 10):
        made = decontaminate.match_items(before, items, shard_chars=chars)
        assert kept(made, before) == ["_matched"] and [r["_matched"]["items"] for r in made.sort("doc_id").collect()] == [["1", "2"], [], [], ["1", "2"]]
    assert decontaminate.decontaminate(before, items).columns == before.columns


def test_chats(spark):
    row = spark.sql("SELECT struct(array(struct('user' AS role, 'hi' AS content)) AS messages) AS record, 'a' AS canonical, 'b' AS layout, 'c' AS formatted, 'd' AS loss_runs")
    made = chat.canonical_turns(row, "record")
    assert kept(made, row) == ["_layout", "_canonical"]
    done = chat.format_chat(made, turns="_canonical")
    assert kept(done, made) == ["_formatted", "_loss_runs"] and "hi" in done.first()["_formatted"]


def test_gumbel_law_of_few_and_of_many_texts():
    import numpy as np

    rng = np.random.default_rng(1)
    size = rng.integers(50, 500, 400).astype(float)
    best = rng.gumbel(0, 1, 400) / 2 + np.log(size) / 2
    rate, log_k = toxicity._gumbel(best, size)
    assert abs(rate - 2) < 0.3 and abs(log_k) < 0.4
    assert toxicity._gumbel(best[:29], size[:29]) == (1.0, 0.0) and toxicity._gumbel(best[:30], size[:30]) != (1.0, 0.0)
    assert toxicity._gumbel(np.ones(50), np.full(50, 9.0)) == (1.0, 0.0) and toxicity._gumbel(np.zeros(0), np.zeros(0)) == (1.0, 0.0)
