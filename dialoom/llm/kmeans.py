"""Exact integer k-means: distances by matrix products in float64, sums by a tree of partial sums.

Squared distances are expanded to |x|² - 2 x·c + |c|². Of integers, each
product and partial sum of a float64 matrix product is exact while it stays
below 2^53; vectors for which a bound of magnitudes doesn't prove that are
worked out with Python's unbounded integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, sliced, table, tidy

#: Components are floor(SCALE * x), a power of two, so that scaling is exact.
SCALE = 256
#: Integers up to this are exact in float64, and so are sums that stay below it.
EXACT = 1 << 53
#: Vectors in one block of a matrix product.
BLOCK = 4096
#: The largest value of a long column; greater distances are given as this.
LONG = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(SCALE * x) for any finite float64."""
    return int(np.floor(x * SCALE)) if abs(x) < EXACT else int(x) * SCALE


def integers(block: np.ndarray) -> np.ndarray:
    """Components as Python integers, whatever their size."""
    return np.array([[whole(x) for x in row] for row in block.tolist()], dtype=object).reshape(block.shape)


class Centroids:
    """Centroids as Python integers, with what blocks of vectors need to be compared with them."""

    def __init__(self, rows: list[list[int]]):
        self.rows, self.size = rows, max((abs(x) for r in rows for x in r), default=0)
        self.squares = [sum(x * x for x in r) for r in rows]
        if self.size < EXACT:
            self.matrix = np.array(rows, np.float64).reshape(len(rows), -1)
            self.norms = np.array([float(min(s, EXACT)) for s in self.squares])

    def nearest(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids, squared distances (integers) and which rows float64 was proved exact for.

        `block` is n x d of float64; a component stands for floor(SCALE * x).
        Of equally near centroids the smaller number wins. Of a row with
        magnitude m, every partial sum is at most d * (m + size)^2.
        """
        n, d = block.shape
        with np.errstate(over="ignore"):
            scaled = np.floor(block * SCALE)
        # One more than both magnitudes, so that rounding of the bound itself doesn't matter.
        limit = (EXACT // max(d, 1)) ** 0.5 - self.size - 2 if self.size < EXACT else -1.0
        small = np.abs(scaled).max(axis=1, initial=0) < limit
        at, far = np.zeros(n, np.int64), np.zeros(n, object)
        if small.any():
            x = scaled[small]
            found = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.matrix.T) + self.norms
            at[small] = found.argmin(axis=1)
            far[small] = found.min(axis=1).astype(np.int64).tolist()
        for i in np.flatnonzero(~small):
            row = integers(block[i : i + 1])[0]
            each = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in self.rows]
            far[i] = min(each)
            at[i] = each.index(far[i])
        return at, far, small


def vectors(df: DataFrame, dim: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of the vectors with `dim` components, none null or non-finite; x as doubles."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    wide = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    return wide.where((F.size("x") == dim) & finite)


def start(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest sha256 of `seed:vec_id`, in that order; ties by components, null ids last.

    Each partition keeps its k smallest; k rows come to the driver.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return [[whole(v) for v in r["x"]] for r in rows]


def packed(kept: DataFrame, dim: int) -> DataFrame:
    """Rows (ids, data) of up to BLOCK vectors each: what one matrix product works on, not a row object for each vector."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(arrived, BLOCK, 8 * dim * BLOCK):
            data = np.asarray(batch.column(1).flatten(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], names=["ids", "data"])

    return materialize(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "ids array<long>, data binary"), "kmeans-blocks", BLOCK, 8 * dim * BLOCK)


def totals(blocks: DataFrame, centroids: Centroids, dim: int, *, with_sums: bool) -> tuple[list[int], list[int], list[list[int]]]:
    """Vectors, summed distances and (if wanted) summed components of each cluster, over all blocks.

    A task folds its blocks into one set of sums; the sets meet by
    `treeAggregate`, so the driver gets few of them, of k x dim integers each.
    """
    k = len(centroids.rows)

    def add(acc, row):
        if acc is None:
            acc = [0] * k, [0] * k, [[0] * dim for _ in range(k)] if with_sums else []
        block = np.frombuffer(row["data"], np.float64).reshape(-1, dim)
        at, far, small = centroids.nearest(block)
        counts, inertia, sums = acc
        for c, n in enumerate(np.bincount(at, minlength=k).tolist()):
            counts[c] += n
        for c in np.unique(at).tolist():
            mine = at == c
            inertia[c] += sum(far[mine].tolist())
            if with_sums:
                # A row proved exact is below 2^27 in each component: int64 holds the sum of any block of such rows.
                part = np.floor(block[mine & small] * SCALE).astype(np.int64).sum(axis=0).tolist()
                for row_ in integers(block[mine & ~small]).tolist():
                    part = [a + b for a, b in zip(part, row_)]
                sums[c] = [a + b for a, b in zip(sums[c], part)]
        return counts, inertia, sums

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        plus = lambda x, y: [i + j for i, j in zip(x, y)]
        return plus(a[0], b[0]), plus(a[1], b[1]), [plus(x, y) for x, y in zip(a[2], b[2])]

    found = blocks.select("data").rdd.treeAggregate(None, add, merge, depth=3)
    return found or ([0] * k, [0] * k, [[0] * dim for _ in range(k)])


def cluster(df: DataFrame, *, dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all vectors with `dim` finite components.

    Other vectors, null ones included, have no row. Repeated rows and ids
    count as often as they stand; null ids are clustered and start no cluster
    while others can. Fewer than k vectors give as many clusters; no vectors,
    no rows. Other columns don't matter. Distances and inertia are exact; in
    the long columns, greater ones are given as the greatest long.
    """
    spark = df.sparkSession
    kept = vectors(df, dim, id_col=id_col, vector_col=vector_col)
    first = start(kept, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    blocks = packed(kept, dim)
    now = Centroids(first)
    for _ in range(rounds):
        counts, _, sums = totals(blocks, now, dim, with_sums=True)
        now = Centroids([[s // n for s in row] if n else old for n, row, old in zip(counts, sums, now.rows)])
    _, inertia, _ = totals(blocks, now, dim, with_sums=False)
    cap = lambda values: [min(v, LONG) for v in values]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.rows]
    own, overall, final = np.array(cap(inertia), np.int64), min(sum(inertia), LONG), now

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = pa.array(names, pa.string())
        for batch in arrived:
            for ids, data in zip(batch.column(0), batch.column(1)):
                at, far, _ = final.nearest(np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(at.astype(np.int32)), pa.array(cap(far.tolist()), pa.int64()), pa.array(own[at]), pa.array(np.full(len(at), overall, np.int64)), digests.take(pa.array(at))],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        tidy()

    return blocks.mapInArrow(run, schema)


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all embeddings, after five rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))
