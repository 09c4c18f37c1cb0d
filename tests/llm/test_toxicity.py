import math
import random
import zlib

import numpy as np

from dialoom.llm import toxicity as tx


def maximal(scores):
    """All maximal segments by definition: the best segment, then those left and right of it."""
    best = (0.0, 0, 0)
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best[0] + 1e-12:
                best = (total, a, b + 1)
    if not best[0]:
        return []
    _, a, b = best
    return [*maximal(scores[:a]), best, *[(s, x + b, y + b) for s, x, y in maximal(scores[b:])]]


def test_segments_equal_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(400):
        scores = rng.normal(-0.2, 1, rng.integers(0, 14))
        got = sorted((round(s, 6), a, b) for s, a, b in tx.segments(scores))
        assert got == sorted((round(s, 6), a, b) for s, a, b in maximal(scores.tolist()))


def documents(spark, n=600):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [pick.choice("the of and to in is it on as at by or an be we he".split()) + pick.choice("abcd") for _ in range(pick.randint(30, 120))]
        if toxic:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), pick.choice(["vileword", "grossest", "zorkish" + pick.choice("abcdefghij")]))
        rows.append((i, " ".join(words), "x"))
        if i % 3:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = documents(spark)
    model = tx.train_model(docs, labels)
    rows = [r for r in tx.score(docs, model).collect() if r.doc_id % 3 == 0 or zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 200 and sum((r.toxicity.score >= 0.5) == (r.doc_id % 8 == 0) for r in rows) / len(rows) > 0.97
    assert all(r.toxicity.passages for r in rows if r.toxicity.score >= 0.5)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 500 < kept.count() < 540


def test_odd_rows(spark):
    docs, labels = documents(spark, 80)
    odd = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, "!!!", "x")], docs.schema)
    more = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1)], labels.schema)
    scores = [r.toxicity.score for r in tx.score(odd, tx.train_model(docs, labels.union(more))).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] < 0.5
    nothing = tx.train_model(docs, labels.limit(0))
    assert all(r.toxicity.score < 0.5 for r in tx.score(docs, nothing).collect())
    assert tx.score(docs.limit(0), nothing).count() == 0 and tx.drop_toxic(docs.limit(0), labels).count() == 0


def test_curve_is_fitted_on_what_it_is_applied_to(spark):
    docs, labels = documents(spark, 400)
    rows = [(r.doc_id, " ".join([r.text] * (20 if r.doc_id % 16 == 0 else 1)), "x") for r in docs.collect()]
    model = tx.train_model(spark.createDataFrame(rows, docs.schema), labels)
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    found = {i: model.passages(t) for i, t, _ in rows if i in known}
    assert max(map(len, found.values())) > 8
    want = tx._logistic(np.log1p([sum(x for x, _, _ in found[i]) for i in known]), np.array(list(known.values()), float))
    assert np.allclose(model.curve, want, rtol=1e-6)


def test_scan_is_linear():
    import time

    for scores in (np.where(np.arange(1_000_000) % 10 == 0, 1.0, -2.0), np.tile([1.0, -2.0, 3.0, -0.5], 250_000), np.concatenate([np.tile([1.0, -1.5], 250_000), np.tile([1.0, -0.5], 250_000)])):
        began = time.time()
        found = tx.segments(scores)
        assert time.time() - began < 3 and found and all(s > 0 for s, _, _ in found)


def test_model_parts_by_plain_python():
    counts = {b"vileword": (1, 9), b"the": (40, 8), b"3^vil": (2, 10), b"4^vile": (1, 9)}
    odds = tx._log_odds(counts, 4.0)
    root = (9 + 8 + 1) / (1 + 9 + 40 + 8 + 2)
    three = (10 + 4 * root) / (12 + 4)
    four = (9 + 4 * three) / (10 + 4)
    word = (9 + 4 * four) / (10 + 4)
    for unit, q in ((b"3^vil", three), (b"4^vile", four), (b"vileword", word), (b"the", (8 + 4 * root) / (48 + 4))):
        assert abs(odds[unit] - (np.log(q / (1 - q)) - np.log(root / (1 - root)))) < 1e-9
    rng = np.random.default_rng(3)
    size = rng.integers(50, 500, 20_000).astype(float)
    rate, log_k = tx._gumbel(rng.gumbel((np.log(size) - 1.0) / 0.7, 1 / 0.7), size)
    assert abs(rate - 0.7) < 0.03 and abs(log_k + 1.0) < 0.1
    x = rng.normal(0, 1, 20_000)
    a, b = tx._logistic(x, (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float))
    assert abs(a - 0.5) < 0.1 and abs(b - 1.5) < 0.1


def test_log_odds_of_words_in_many_toxic_documents_only():
    counts = {b"the": (45_000, 5_000), **dict.fromkeys(tx.units(b"vilewords"), (0, 5_000)), **dict.fromkeys(tx.units(b"kindwords"), (45_000, 0))}
    odds = tx._log_odds(counts, 4.0)
    # Six levels, each with 4 of 5004 parts of the one above: exact sums in logarithms.
    y0, y1 = 90_001, 10_001
    other = math.log(y0 / (y0 + y1)) + 6 * math.log(4 / 5_004)
    assert abs(odds[b"vilewords"] - (math.log1p(-math.exp(other)) - other - math.log(y1 / y0))) < 1e-9
    toxic = math.log(y1 / (y0 + y1)) + 6 * math.log(4 / 45_004)
    assert abs(odds[b"kindwords"] - (toxic - math.log1p(-math.exp(toxic)) - math.log(y1 / y0))) < 1e-9


def test_stage_with_a_word_in_many_toxic_documents(spark):
    docs = spark.range(12_000).selectExpr("id doc_id", "concat('some plain words of number ', id % 50, if(id % 3 = 0, ' vilewordsome', '')) text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    assert tx.drop_toxic(docs, labels).where("doc_id % 3 = 0").count() == 0
