import random

from pyspark.sql import functions as F

from dialoom.llm.quality import host_verdicts, judge, measures


def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(3)}
    return len(hit)


def test_measures_equal_plain_counts(spark):
    pick = random.Random(1)
    texts = ["".join(pick.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\xa0"]) for _ in range(pick.randint(0, 80))) for _ in range(300)] + [None, "", "a b c a b c a b c", "x\nx\n \nx y\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", measures(F.col("t")).alias("m")).collect():
        t = texts[r.i] or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        lines = [x for x in t.split("\n") if x.strip("\t ")]
        assert (r.m.n_words, r.m.word_chars, r.m.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r.m.lines.n, r.m.lines.dup, r.m.n_repeat_words) == (len(lines), len(lines) - len(set(lines)), repeated(words)), t


def test_long_repeating_text_takes_no_quadratic_time(spark):
    df = spark.createDataFrame([("a b c d e f g h " * 40_000,)], "t string")
    assert df.select(measures(F.col("t")).alias("m")).first().m.n_repeat_words == 320_000


def rows(host, bad, good):
    return [(host, False, True, False, False)] * bad + [(host, False, False, False, False)] * good


def test_hosts_are_shrunk_to_the_mean(spark):
    data = rows("bad", 95, 5) + rows("good", 5, 500) + rows("tiny", 1, 0) + rows(None, 0, 40) + rows("mid", 10, 90)
    out = {r.host: r for r in host_verdicts(spark.createDataFrame(data, "host string, short boolean, repetitive boolean, symbols boolean, dup_lines boolean")).collect()}
    assert out["bad"].rejected and not out["good"].rejected and not out[None].rejected
    assert 0.1 < out["tiny"].repetitive_rate < 1 and 0.5 < out["bad"].repetitive_rate < 0.95


def test_judge(spark):
    good, junk = " ".join(f"w{i}" for i in range(60)), "a b c " * 30
    data = [(i, good, "g", "x") for i in range(30)] + [(100 + i, junk, "h", "x") for i in range(30)] + [(200, good, "h", "x"), (300, None, None, "x"), (301, good, None, "x"), (301, good, None, "x")]
    got = {}
    for r in judge(spark.createDataFrame(data, "doc_id long, text string, source string, host string")).collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert got[0] == [(False, True)] and got[100] == [(True, False)] and got[200] == [(False, False)] and got[300] == [(True, False)] and got[301] == [(False, True)] * 2
    assert judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
