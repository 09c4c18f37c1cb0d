import random
from collections import defaultdict

from dialoom.llm.mixing import mix, mix_counts, source_targets


def documents(spark, n=3000):
    pick = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(pick.randint(0, 30))) or None, pick.choice(["a"] * 12 + ["b", "c", "d", None]), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def plain_targets(sizes, budget=1.5, most=2):
    """Sharing out what full sources leave, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else weight[s] * share
            left -= target[s]
        open_ -= full or open_
    return target


def test_targets_equal_repeated_sharing(spark):
    pick = random.Random(9)
    for _ in range(6):
        sizes = {s: pick.choice([0, 1, 10, 1000, 50_000]) + pick.randint(0, 9) for s in [None, "é", "z", "A", "a", "aa"]}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert all(abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) for r in got) and len(got) == len(sizes)


def test_sources_come_near_their_targets(spark):
    docs = documents(spark)
    got = mix_counts(docs, fan_out=16).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    text = {r.doc_id: r for r in docs.collect()}
    for r in got:
        s = text[r.doc_id].source
        assert r.size == len((text[r.doc_id].text or "").split()) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        target[s], most[s] = r.target, max(most[s], r.size)
    assert len(got) == 3000 and all(abs(taken[s] - target[s]) <= 2 * most[s] for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_counts(docs.repartition(7), fan_out=16).collect()))
    rows = mix(docs, fan_out=16)
    copies = defaultdict(int)
    for r in rows.collect():
        copies[r.doc_id] += 1
    assert rows.columns == docs.columns and all(copies[r.doc_id] * r.size == r.taken for r in got if r.size)


def test_odd_tables(spark):
    docs = documents(spark, 5)
    assert mix_counts(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    same = docs.limit(1).union(docs.limit(1))
    assert mix_counts(same).count() == 2
    empty = spark.createDataFrame([(1, None, None, 0), (None, "", "x", 0)], docs.schema)
    assert [r.taken for r in mix_counts(empty).collect()] == [0, 0]
