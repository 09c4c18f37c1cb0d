import math
import random

import numpy as np

from dialoom.llm import near_dedup as nd
from dialoom.llm.decontaminate import words_of


def corpus(seed=1, groups=14, alone=40):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 6)))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(pick.randint(60, 200))]
        for _ in range(1 if g % 3 else 12):
            for rate in (0.0, 0.01, 0.01, 0.02, 0.08):
                texts.append(" ".join(word() if pick.random() < rate else w for w in base))
    shared = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(90)] + shared) for _ in range(alone)]
    pick.shuffle(texts)
    return texts


def idf_of(texts):
    """log(1 + N / df) over kinds of texts, by plain sets; what stands in under one text of a hundred weighs as at one."""
    kinds, df, n = set(), {}, {}
    for t in texts:
        own = set(nd.shingles(words_of(t))[0].tolist())
        if own:
            kinds.add(min(own))
            for h in own:
                df.setdefault(h, set()).add(min(own))
                n[h] = n.get(h, 0) + 1
    return {h: math.log(1 + len(kinds) / max(len(k), 0.01 * len(kinds))) if n[h] >= 0.01 * len(texts) else math.log(101) for h, k in df.items()}


def brute(texts):
    idf = idf_of(texts)
    sets = [nd.shingles(words_of(t)) for t in texts]
    vectors = [{h: c * idf[h] for h, c in zip(sh.tolist(), counts.tolist(), strict=True)} for sh, counts in sets]

    def similarity(a, b):
        low = sum(min(w, b[h]) for h, w in a.items() if h in b)
        return low / (sum(a.values()) + sum(b.values()) - low)

    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if vectors[i] and vectors[j] and similarity(vectors[i], vectors[j]) >= nd.SIMILAR:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_buckets_dealt_over_many_tasks_give_the_same_classes(spark, monkeypatch):
    for name, few in (("SLICE", 3), ("BLOCK", 4), ("TILE", 2)):
        monkeypatch.setattr(nd, name, few)
    # Shared halves bring texts of many classes into common buckets.
    texts = corpus(4, 6, 30) + corpus(5, 6, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_blocks_bring_each_outside_member_and_member_once(spark, monkeypatch):
    for name, few in (("BLOCK", 4), ("TILE", 2)):
        monkeypatch.setattr(nd, name, few)
    rows = [(k, b"%d" % i, n, b"l", n_out, i < n_out) for k, n, n_out in ((1, 70, 30), (2, 90, 1), (3, 3, 2), (4, 17, 16)) for i in range(n)]
    members = spark.createDataFrame(rows, "key long, node binary, n long, label binary, n_outside long, outside boolean").selectExpr("*", "1D w", "1D s")
    nodes = spark.createDataFrame([(b"%d" % i, [i], [i]) for i in range(90)], "node binary, sketch array<int>, bands array<long>")
    got = [(r.key, bytes(m.node), bytes(x.node)) for r in nd._blocks(members, nodes).collect() for m in r.out for x in r.all]
    assert sorted(got) == sorted((k, m, x) for k, m, *_, out in rows if out for j, x, *_ in rows if j == k)


def test_words_are_hashed_alike_wherever_they_stand_and_without_a_call_each(monkeypatch):
    pick, calls, one = random.Random(5), [], nd.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(nd.xxhash, "xxh3_64_intdigest", lambda word: calls.append(word) or one(word))
    # Words of all lengths around those of eight bytes, and such that differ in one byte only.
    base = [pick.choice("abé字9") * n for n in (*range(1, 40), 63, 64, 65, 66, 300)]
    words = sorted({w.encode() for b in base for w in (b, b + "x", "x" + b, b[: len(b) // 2] + "q" + b[len(b) // 2 :])})
    texts = [b" ".join(pick.choices(words, k=k)) for k in (0, 1, 4, 5, 6, 200, 0, 3, 900, 0)] + [b"  ", b" ".join(words), b"  ".join([b"", *words, b""])]
    hashes, at = nd.word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(t.split())
        for w, h in zip(t.split(), own, strict=True):
            assert seen.setdefault(w, h) == h
    assert at[-1] == len(hashes) and set(seen) == set(words) and len(set(seen.values())) == len(words)
    assert calls and all(len(w) > nd.LONG_WORD for w in calls)
    # The shingles of a text don't depend on what stands beside it, and are as many as a plain count finds.
    for t, (sh, counts) in zip(texts, nd.shingle_sets(texts), strict=True):
        own = nd.shingles(w := t.split())
        assert (sh == own[0]).all() and (counts == own[1]).all() and (np.diff(sh.astype(object)) > 0).all()
        plain = {}
        for i in range(max(1, len(w) - 4) if w else 0):
            plain[tuple(w[i : i + 5])] = plain.get(tuple(w[i : i + 5]), 0) + 1
        assert sorted(counts.tolist()) == sorted(plain.values())
    assert nd.shingle_sets([]) == []


def test_samples_agree_as_often_as_texts_are_similar():
    import numpy as np

    pick = random.Random(3)
    a = [f"w{pick.randint(0, 99999)}" for _ in range(400)]
    b = [w if pick.random() > 0.03 else "x" + w for w in a]
    sets = [nd.shingles(w) for w in (list(map(str.encode, a)), list(map(str.encode, b)))]
    weights = [c * 1.25 for _, c in sets]
    sketch = nd.Sampler(2000, 5).sketch(np.concatenate([s for s, _ in sets]), np.concatenate(weights), np.array([len(s) for s, _ in sets]))
    true = nd.similarity((sets[0][0], weights[0]), (sets[1][0], weights[1]))
    assert abs((sketch[0] == sketch[1]).mean() - true) < 0.04


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, "A, b! c", "x"), (3, None, "x"), (4, None, "x"), (5, "", "x"), (6, "...", "x"), (7, "...", "x"), (8, "a b", "x"), (1, "a b c", "x"), (None, "q r s t u v", "x"), (None, "q r s t u v", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.near_classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (None, None), (None, None)], key=str)
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert nd.near_classes(docs.limit(0)).count() == 0 and nd.dedup(docs.limit(0)).count() == 0


def test_dedup_keeps_one_of_each_class(spark):
    texts = corpus(2, 6, 10)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    assert sorted(r.doc_id for r in nd.dedup(docs).collect()) == sorted(set(brute(texts)))


def test_dedup_tells_classes_of_one_id_apart(spark):
    rows = [(None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (3, "g h i j k l"), (3, "m n o p q r"), (4, "m n o p q r")]
    kept = nd.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "a b c d e f"), (None, "q r s t u v"), (3, "g h i j k l"), (3, "m n o p q r")], key=str)


def test_common_shingles_are_those_of_a_plain_count(spark):
    pick = random.Random(7)
    often = [" ".join(f"o{k}w{i}" for i in range(9)) for k in range(4)]
    texts = [" ".join([*[f"r{pick.random()}" for _ in range(30)], *([often[i % 4]] if i % 3 == 0 else [])]) for i in range(900)] + ["", "..."]
    texts += [" ".join(f"same{i}" for i in range(40))] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    weights = nd.Weights(*nd.common_shingles(docs, "text", len(texts)))
    want = idf_of(texts)
    got = weights.of(np.array(list(want), np.uint64), np.ones(len(want)))
    assert len(weights.hashes) == 4 * 5 + 36 and np.allclose(got, list(want.values()))
    # Three hundred copies are one text to their shingles.
    assert abs(max(want.values()) - want[nd.shingles(words_of(texts[-1]))[0][0]]) < 1e-9


def test_long_texts_give_few_common_shingles(spark):
    pick = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(50))
    texts = [" ".join([shared, *[f"{pick.random():.9f}" for _ in range(5_000)]]) for _ in range(270)]
    got = nd.common_shingles(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), "text", 270)
    assert 46 <= len(got[0]) <= 60 and max(n for _, n in got[0]) == got[1] > 100


def test_every_pair_is_verified_on_demand(spark):
    texts = corpus(3, 5, 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_needed_texts_are_found_by_the_bit_map(spark):
    rows = [(i if i % 9 else None, f"text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    keys = docs.where("cast(substring(text, 6) as int) % 7 = 0").select(nd._key(F.col("doc_id"), F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("text_key"))
    some, own, others = nd.split_rows(docs, keys, "doc_id", "text")
    got, left = {r.text for r in some.collect()}, {r.text for r in others.collect()}
    assert not got & left and len(got | left) == 2000 and {t for _, t in rows if int(t[5:]) % 7 == 0} <= got and len(got) < 400


def similar_pairs(sets, df, similar):
    """All pairs of weighted sets of this similarity or more: such share one of each other's rarest shingles, which are over a fifth of the weight."""
    index, found = {}, set()
    for i, (sh, w) in enumerate(sets):
        order = sorted(range(len(sh)), key=lambda k: (df[int(sh[k])], int(sh[k])))
        total, seen, near = w.sum(), 0.0, set()
        for k in order:
            near |= set(index.get(int(sh[k]), ()))
            index.setdefault(int(sh[k]), []).append(i)
            seen += w[k]
            if seen > (1 - similar + 1e-6) * total:
                break
        found |= {(j, i) for j in near if nd.similarity(sets[i], sets[j]) >= similar}
    return found


def test_all_similar_pairs_of_a_given_table_are_in_one_class(spark):
    import collections
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        return
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = docs.collect()
    weights = nd.Weights(*nd.common_shingles(docs, "text", len(rows)))
    raw = [nd.shingles(words_of(r.text or "")) for r in rows]
    df = collections.Counter(int(h) for sh, _ in raw for h in sh)
    sets = [(sh, weights.of(sh, counts)) for sh, counts in raw]
    pairs = similar_pairs(sets, df, nd.SIMILAR)
    got = {r.doc_id: r["class"] for r in nd.near_classes(docs).collect()}
    same = [got[rows[i].doc_id] == got[rows[j].doc_id] is not None for i, j in pairs]
    near = [s for s, (i, j) in zip(same, pairs) if rows[i].text != rows[j].text]
    assert len(pairs) > 50 and len(near) > 3 and sum(same) >= 0.99 * len(same) and sum(near) >= 0.9 * len(near)
    # Nothing else is: a class is held together by such pairs.
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        label[max(top(i), top(j))] = min(top(i), top(j))
    own = {}
    for i, r in enumerate(rows):
        if got[r.doc_id] is not None:
            assert own.setdefault(got[r.doc_id], top(i)) == top(i)
