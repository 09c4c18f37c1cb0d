import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dialoom.llm import lm


def plain(texts, words, i):
    """p(w|h) straight from the formula, counting in the texts anew."""
    own = [lm.tokens(t) for t in texts]

    def count(gram):
        return sum(t[j : j + len(gram)] == gram for t in own for j in range(len(t) - len(gram) + 1))

    n, v = sum(map(len, own)), len({w for t in own for w in t})
    p = (count([words[i]]) + 1) / (n + v + 1)
    for k in range(1, min(i, 2) + 1):
        h = words[i - k : i]
        if whole := count(h):
            p = (count(h + [words[i]]) + lm.PRIOR[k - 1] * p) / (whole + lm.PRIOR[k - 1])
    return p


def test_automaton_is_the_formula_and_sums_to_one():
    pick = random.Random(1)
    texts = [" ".join(pick.choice("aabbc") for _ in range(pick.randint(0, 9))) for _ in range(30)] + [None]
    auto = lm.Automaton(texts)
    for _ in range(40):
        words = [pick.choice([b"a", b"b", b"c", b"x"]) for _ in range(pick.randint(0, 6))] + [b"\n"]
        assert math.isclose(auto.walk(words), sum(math.log10(plain(texts, words, i)) for i in range(len(words))), rel_tol=1e-9)
    for s in auto.states.values():
        assert math.isclose(sum(10 ** auto.cost(s, w) for w in (b"a", b"b", b"c", b"\n", b"unknown")), 1, rel_tol=1e-9)


def test_scores_are_those_of_the_automaton(spark):
    pick = random.Random(2)
    texts = {i: " ".join(pick.choice(["The", "the", "cat", "sat", "on", "É", f"x{i}"]) for _ in range(pick.randint(0, 60))) for i in range(200)}
    texts[200] = None
    rows = [(i, t, "x") for i, t in texts.items()] + [(7, texts[7], "x"), (None, "The cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train string").repartition(3)
    learnt = [t for i, t, _ in rows if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2]
    auto = lm.Automaton(learnt)
    counts = Counter(w for t in learnt for w in lm.tokens(t))
    n, v = counts.total(), len(counts)
    by_text = {i: t for i, t, _ in rows}
    for chunk, part in ((50, 40), (10**6, 10**6)):
        out = lm.score(docs, ~lm.held_out(F.col("doc_id")), chunk=chunk, part=part).collect()
        assert len(out) == 203
        for r in out:
            own = lm.tokens(by_text[r.doc_id])
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
            assert math.isclose(r.score, auto.walk(own), rel_tol=1e-9)
            assert (r.n_known, r.train_tokens, r.n_tokens) == (sum(counts[w] > 0 for w in own), n, len(own))
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_keys_round_trip():
    pick = np.random.default_rng(3)
    for bits in (40, 44, 48, 52, 63, 64):
        for n in (0, 1, 3, 10_000):
            keys = np.unique(pick.integers(0, 2**bits, n, dtype=np.uint64))
            assert (lm.unpack_keys(lm.pack_keys(keys, bits), len(keys), bits) == keys).all()
            assert lm._bounds(keys, bits, 7)[[0, -1]].tolist() == [0, len(keys)]


def test_long_text_and_held_out_gain(spark):
    pick = random.Random(5)
    base = [" ".join(pick.choice("abcdefghij") + pick.choice("klmno") for _ in range(30)) for _ in range(40)]
    rows = [(i, " ".join(pick.choice(base) for _ in range(3))) for i in range(400)] + [(400, " ".join(pick.choice(base) for _ in range(20_000)))]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), ~lm.held_out(F.col("doc_id")), chunk=5_000).collect()
    assert len(out) == 401 and max(r.n_tokens for r in out) == 600_001
    unseen = [r for r in out if not r.train]
    assert sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen) > 0.5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert lm.score(one, F.lit(None).cast("boolean")).first().n_known == 0


def test_states_are_carried_over_lanes(monkeypatch):
    """One walk of a chunk gives what the automaton in memory gives, wherever its tokens are cut into lanes."""
    pick = random.Random(7)
    texts = [" ".join(pick.choice("aaabbcde") for _ in range(pick.choice([0, 1, 2, 3, 40, 500]))) for _ in range(60)]
    train = np.array([pick.random() < 0.7 for _ in texts])
    auto = lm.Automaton([t for t, x in zip(texts, train) if x])
    own = [lm.tokens(t) for t in texts]
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for t in own for w in t])
    hashes = np.array([hash(w) & (2**64 - 1) for w in names], np.uint64)
    sizes = np.array([len(t) for t in own])
    row = {"n": len(ids), "words": lm._planes(hashes, 8), "n_words": len(names), "ids": lm._planes(ids), "sizes": sizes.astype("<u4").tobytes(), "train": train.tobytes()}
    chunk = lm._Chunk(row, 63)
    learnt = chunk.token_train()
    words = np.bincount(chunk.rank[chunk.ids], learnt, len(names))
    every = np.concatenate(chunk.keys)
    seen = np.concatenate([learnt[at] for at in chunk.places])
    keys, place = np.unique(every, return_inverse=True)
    grams = np.bincount(place, seen, len(keys))
    want = [auto.walk(t) for t in own]
    arcs = lm.Arcs(chunk, words, grams, auto.n_tokens, auto.n_words)
    for lanes in (1, 7, 100, 8192):
        monkeypatch.setattr(lm, "LANES", lanes)
        known, base, total = lm.walked(arcs)
        assert np.allclose(total, want, rtol=1e-12) and known.sum() == sum((0, w) in auto.arcs for t in own for w in t)
    assert (np.diff(arcs.keys) > 0).all() and len(arcs.keys) - 1 == len(auto.arcs) - sum(s == 0 for s, _ in auto.arcs)


def test_a_chunk_without_training():
    row = {"n": 3, "words": lm._planes(np.array([5, 9], np.uint64), 8), "n_words": 2, "ids": lm._planes(np.array([0, 0, 1])), "sizes": np.array([3], "<u4").tobytes(), "train": np.array([False]).tobytes()}
    chunk = lm._Chunk(row, 63)
    known, base, total = lm.walked(lm.Arcs(chunk, np.zeros(2), np.zeros(3), 0, 0))
    assert known.tolist() == [0] and base.tolist() == total.tolist() == [0.0]
