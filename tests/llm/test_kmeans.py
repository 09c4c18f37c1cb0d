import hashlib
import math
import random

import numpy as np

from dialoom.llm.kmeans import BLOCK, LONG, Centroids, cluster, integers

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, dim, seed=2):
    """Lloyd's rounds in Python's integers."""
    kept = [(i, [math.floor(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centers)), key=lambda j: (far(v, centers[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centers)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    each = [far(v, centers[a]) for (_, v), a in zip(kept, at)]
    cap = lambda x: min(x, LONG)
    own = [sum(d for d, b in zip(each, at) if b == j) for j in range(len(centers))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, a, cap(d), cap(own[a]), cap(sum(each)), name[a]) for (i, _), a, d in zip(kept, at, each)), key=str)


def clustered(spark, rows, dim, k=7, rounds=4, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in cluster(frame, dim=dim, k=k, rounds=rounds).collect()), key=str)


def test_equals_integer_rounds_with_odd_rows(spark):
    pick = random.Random(3)
    rows = [(i, [round(pick.gauss(0, 1), pick.choice([0, 1, 6])) for _ in range(5)]) for i in range(400)]
    rows += rows[:40] + [(None, [0.5] * 5), (1000, None), (1001, [1.0] * 4), (1002, [None, 1.0, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 5), (1004, [float("inf")] * 5), (1005, [1.0] * 6), (1006, [])]
    assert clustered(spark, rows, 5) == plain(rows, 7, 4, 5)


def test_values_beyond_exact_doubles(spark):
    pick = random.Random(4)
    rows = [(i, [pick.choice([1, -1]) * pick.random() * 10.0 ** pick.choice([0, 3, 6, 9, 30, 300]) for _ in range(3)]) for i in range(120)]
    rows += [(500 + i, [pick.gauss(0, 1) for _ in range(3)]) for i in range(120)] + [(900, [1.7e308, -1.7e308, 2.0**53])]
    assert clustered(spark, rows, 3, k=5) == plain(rows, 5, 4, 3)


def test_guard_sends_rows_to_integers_at_its_bound():
    dim, size = 64, 4096
    centers = Centroids([[size] * dim, [-size] * dim])
    bound = int((2**53 // dim) ** 0.5) - size - 2
    block = np.array([[(bound + d) / 256] * dim for d in (-2, -1, 0, 1, 50)])
    at, far, small = centers.nearest(block)
    assert small.tolist() == [True, True, False, False, False] or small.tolist() == [True, True, True, False, False]
    assert far.tolist() == [sum((x - size) ** 2 for x in row) for row in integers(block).tolist()] and at.tolist() == [0] * 5
    # The largest products that float64 is trusted with stay below 2^53.
    assert all(dim * (max(map(abs, row)) + size) ** 2 < 2**53 for row in integers(block[small]).tolist())


def test_few_vectors_none_ties_and_empty_clusters(spark):
    assert clustered(spark, [], 5) == [] and clustered(spark, [(1, None), (2, [1.0])], 5) == []
    rows = [(i, [float(i % 2)] * 4) for i in range(6)]
    assert clustered(spark, rows, 4, k=40) == plain(rows, 40, 4, 4)
    same = [(i, [1.5, -1.5]) for i in range(50)]
    got = clustered(spark, same, 2)
    assert got == plain(same, 7, 4, 2) and {r[1] for r in got} == {0}


def test_a_hot_vector_over_several_blocks_and_clashing_columns(spark):
    rows = [(i, [0.25, -0.75], i, i, "x") for i in range(2 * BLOCK + 10)] + [(90_000 + i, [float(i), 1.0], 0, 0, "y") for i in range(30)]
    schema = f"{SCHEMA}, cluster int, x int, data string"
    assert clustered(spark, rows, 2, k=4, rounds=2, schema=schema) == plain([r[:2] for r in rows], 4, 2, 2)
