"""Toxic passages: maximal scoring segments of token log-odds, calibrated by extreme values.

A token's score is its log-odds of toxic against other documents under a
Dirichlet prior centred on its prefix, whose own prior is the shorter prefix,
down to the corpus; so words not seen in training lean on words that begin
alike. Less a drift that makes ordinary text lose, the scores' maximal segments
are found in one pass. The best segment of ordinary texts follows a Gumbel law
in their length: a segment counts with what it exceeds by that law, and a
logistic curve turns the document's sum into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import extend, free_name, sliced, table, worker_cache
from dialoom.llm.decontaminate import words_of

#: Labelled rows that a model is fitted on, at most (by a hash of the id).
MAX_TRAIN = 50_000
#: Documents that a unit must stand in.
MIN_DOCS = 5
PRIOR = 4.0
DRIFT = 2.0
#: Bytes of the prefixes between a word and the corpus.
PREFIXES = (3, 4, 5, 6, 7)
_MEMO = 200_000
UNITS = pa.schema([("unit", pa.binary()), ("y0", pa.int64()), ("y1", pa.int64())])


def units(word: bytes) -> list[bytes]:
    """Prefixes of growing length, then the word, in a space of its own."""
    return [b"%d^%b" % (k, word[:k]) for k in PREFIXES if len(word) > k] + [word]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end): only positive scores open or extend one.

    One scan, in linear time: each segment knows the nearest one before it
    whose sum at its start is less, so the search for one goes along that
    chain and passes by what an earlier search has passed by.
    """
    if not len(scores):
        return []
    ups = np.flatnonzero(scores > 0)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    #: Sums before and after, start, end, place of the nearest one before with a lesser sum before (-1: none).
    found: list[tuple[float, float, int, int, int]] = []
    for i, left, right in zip(ups.tolist(), total[ups].tolist(), total[ups + 1].tolist(), strict=True):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1, j))
                break
            left, _, start, _, before = found[j]
            del found[j:]
            j = before
    return [(r - l, a, b) for l, r, a, b, _ in found]


@dataclass
class Model:
    """Log-odds of units against the corpus, the Gumbel law of ordinary texts, the logistic curve."""

    odds: dict[bytes, float]
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (-3.0, 2.0)
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def token(self, word: bytes) -> float:
        for u in reversed(units(word)):
            if (s := self.odds.get(u)) is not None:
                return s - DRIFT
        return -DRIFT

    def scores(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        missing = [w for w in words if w not in memo]
        if missing:
            if len(memo) + len(missing) > _MEMO:
                memo.clear()
                missing = words
            memo.update((w, self.token(w)) for w in set(missing))
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def passages(self, text: str | None) -> list[tuple[float, int, int]]:
        """Significant segments in words: what each exceeds by the law of ordinary texts."""
        words = words_of(text) if text else []
        beyond = self.log_k + math.log(max(len(words), 1))
        return [(x, a, b) for s, a, b in segments(self.scores(words)) if (x := self.rate * s - beyond) > 0]

    def beyond(self, passages: list[tuple[float, int, int]]) -> float:
        """What the curve is fitted on and applied to."""
        return math.log1p(sum(x for x, _, _ in passages))

    def probability(self, passages: list[tuple[float, int, int]]) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a + b * self.beyond(passages))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _log_odds(counts: dict[bytes, tuple[int, int]], prior: float) -> dict[bytes, float]:
    """Each unit's log-odds less the corpus's; a unit's prior is its longest counted prefix.

    The shares of toxic and of other documents are both kept: along a chain of
    prefixes seen in many toxic documents only, 1 less the one rounds to 0.
    """
    tokens = [c for u, c in counts.items() if u[1:2] != b"^"]
    y0, y1 = sum(c[0] for c in tokens), sum(c[1] for c in tokens)
    root = ((y0 + 1) / (y0 + y1 + 2), (y1 + 1) / (y0 + y1 + 2))
    rates: dict[bytes, tuple[float, float]] = {}

    def rate(u: bytes, chain: list[bytes]) -> tuple[float, float]:
        if u not in rates:
            above = next((c for c in reversed(chain) if c in counts), None)
            other, toxic = root if above is None else rate(above, chain[: chain.index(above)])
            a, b = counts[u]
            rates[u] = ((a + prior * other) / (a + b + prior), (b + prior * toxic) / (a + b + prior))
        return rates[u]

    for u in counts:
        word = u[2:] if u[1:2] == b"^" else u
        chain = [b"%d^%b" % (k, word[:k]) for k in PREFIXES if (k < int(u[:1]) if u[1:2] == b"^" else k < len(word))]
        rate(u, chain)
    base = math.log(root[1] / root[0])
    return {u: math.log(toxic / other) - base for u, (other, toxic) in rates.items()}


def _gumbel(best: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Rate and log K of the law of best segments, by moments, lengths taken out.

    Fewer than thirty ordinary texts, or such that are all alike, have no
    moments worth the name: for them a rate of 1 and a log K of 0 stand.
    """
    if len(best) < 30 or best.std() == 0:
        return 1.0, 0.0
    rate = 1.0
    for _ in range(50):
        spread = (best - np.log(size) / rate).std()
        rate = 0.5 * rate + 0.5 * min(10.0, max(0.2, math.pi / (spread * math.sqrt(6))))
    return rate, float(rate * (best - np.log(size) / rate).mean() - np.euler_gamma)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the ridge keeps parted classes finite."""
    w, m = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (p - y) + ridge * w * [0, 1]
        hess = (m * (p * (1 - p) + 1e-9)[:, None]).T @ m + np.diag([1e-6, ridge])
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def train_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
                max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, prior: float = PRIOR) -> Model:
    """Fit on labelled rows outside the held-out fifth, some `max_train` at most.

    Null labels and ids teach nothing; a document with several labels is toxic
    if one says so. Without any labelled row the model finds nothing toxic.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    part = min(1.0, max_train / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 53)) < int(part * (1 << 53)))
    # At most max_train rows or so, whatever the size of labels.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)
        sums: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(sums)
            for i in range(0, len(keys), 20_000):
                own = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([sums[k][0] for k in own], pa.int64()), pa.array([sums[k][1] for k in own], pa.int64())], schema=UNITS)
            sums.clear()

        for batch in sliced(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(words_of(text or "")):
                    for u in units(w):
                        sums.setdefault(u, [0, 0])[1 if y > 0 else 0] += 1
            if len(sums) > 200_000:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(count, "unit binary, y0 long, y1 long").groupBy("unit").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1")).where(F.col("y0") + F.col("y1") >= min_docs)
    model = Model(_log_odds({bytes(r["unit"]): (r["y0"], r["y1"]) for r in counted.toLocalIterator()}, prior))
    held = spark.sparkContext.broadcast(model)

    def best() -> object:
        own = held.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [words_of(t or "") for t in batch.column(0).to_pylist()]
            top = [max((s for s, _, _ in segments(own.scores(w))), default=0.0) for w in texts]
            return [pa.array(map(len, texts), pa.int64()), pa.array(top, pa.float64())]

        return work

    seen = extend(rows, "n long, best double", best).select("y", "n", "best").collect()
    y = np.array([r["y"] > 0 for r in seen], float)
    size = np.array([max(r["n"], 1) for r in seen], float)
    top = np.array([r["best"] for r in seen], float)
    if 0 < y.sum() < len(y):
        model.rate, model.log_k = _gumbel(top[y == 0], size[y == 0])
        # The curve's statistic needs the law: a second walk, of the passages that scoring finds.
        law = spark.sparkContext.broadcast(Model(model.odds, model.rate, model.log_k))

        def beyond() -> object:
            own = law.value

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                return [pa.array([own.beyond(own.passages(t)) for t in batch.column(0).to_pylist()], pa.float64())]

            return work

        fit = extend(rows, "x double", beyond).select("y", "x").collect()
        model.curve = _logistic(np.array([r["x"] for r in fit], float), np.array([r["y"] > 0 for r in fit], float))
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """`docs` with struct `name`: score (0 to 1) and passages (start, end in words, beyond).

    Null and empty texts have no passage and the least score. Only the text is
    read; other columns stay as they are; repeated rows get equal scores. If
    `name` is taken, the new column has underscores before it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    place, name = docs.columns.index(text_col), free_name(docs, name)
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("beyond", pa.float64())])))])

    def compute():
        own: Model = held.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text in batch.column(place).to_pylist():
                found = own.passages(text)
                rows.append({"score": own.probability(found), "passages": [{"start": a, "end": b, "beyond": x} for x, a, b in found]})
            return [pa.array(rows, kind)]

        return work

    return extend(docs, f"`{name}` struct<score:double,passages:array<struct<start:long,end:long,beyond:double>>>", compute)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """`docs` without those that score `threshold` or more; the model is fitted on `labels`.

    Null and empty texts have the least score and stay, repeated rows go or
    stay together, all columns are returned, whatever their names. Without a
    labelled row nothing is toxic.
    """
    name = free_name(docs, "toxicity")
    model = train_model(docs, labels, text_col=text_col, **options)
    return score(docs, model, text_col=text_col, name=name).where(F.col(f"`{name}`.score") < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train_model(docs, table(spark, sf_dir, "labels")))
    value = F.col("toxicity.score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
