"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set: shingles of five words, each by its count times its
inverse document frequency. Consistent samples of it, banded, bring similar
texts into common buckets; weighted Jaccard similarity of the whole texts
decides every link. Classes are the components of the links.

The inverse document frequency is log(1 + N / df). Texts of one least shingle
hash count as one in df and in N: near copies mostly have the same, so a large
group of copies doesn't lower the weight of what its members share and lose
its own links. Shingles in less than a share `COMMON` of the texts all weigh as
those at that share do.

Within a bucket no two members meet unless they must. First each is compared
with the bucket's leader, the member with most company over all its buckets.
Where a bucket still holds several classes, members outside its main class are
compared with the most typical text of that, and then, as long as they are
outside, with all members of other classes, in blocks. A text is left out of
that if more than a fifth of its weight is in shingles that no candidate of
another class has, and a pair if what its texts can share is too little: both
are exact bounds. So a group of n copies takes n steps.

What can be lost is lost by sampling, with known odds: at similarity 0.8 a pair
shares no bucket in (1 - 0.8**3)**12 = 0.00018 of cases. Within buckets, pairs
are left out by bounds that hold for all pairs: of what they can share, and of
their weights, as similarity is no more than the lesser over the greater.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import discard, free_name, materialize, table, tidy, worker_cache
from dialoom.llm.decontaminate import folded

SIZE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 3
COMMON = 0.01
#: Members of a block of a bucket, and blocks of either side that one task compares.
BLOCK, TILE = 256, 16
#: Members of a bucket that meet its one row in a task; a larger bucket is dealt over several.
SLICE = 1024
#: Slots that count shingles, by the mean of a text's distinct ones, and at most.
SLOTS_EACH, MOST_SLOTS = 8, 1 << 24
#: What bounds give way to rounding.
SLACK = 1e-5
#: Bits for each key that says which texts are needed, and at most: 64 MB are broadcast.
KEY_BITS, MOST_BITS = 64, 1 << 29
_BLOCK_BITS = 1 << 15
#: Bytes of words that are hashed side by side; longer words, which are few, are hashed one by one.
LONG_WORD = 64

_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The first 0 to 8 bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded texts, laid end to end, and the place of each text's first and of the end.

    Words are hashed side by side, eight bytes of each at a time; a call for each word takes most of the operator's time.
    """
    raw = b" ".join([b"", *texts, b" " * 8])
    data = np.frombuffer(raw, np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at].view("<u8")[:, 0] & _BYTES[np.minimum(left, 8)]

    out = _mixed(sizes.astype(np.uint64) * _ODD[30] + part(starts, sizes) * _ODD[31])
    done, more = 8, np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    while len(more):
        out[more] = _mixed(out[more] * _ODD[32] + part(starts[more] + done, sizes[more] - done) * _ODD[31])
        done += 8
        more = more[sizes[more] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return out, np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def shingle_sets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes, sorted, of the five-word shingles of each folded text, and their counts; a shorter text is one shingle."""
    worker_cache("", dict)  # other operators' caches go
    words, at = word_hashes(texts)
    n = max(len(words) - SIZE + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(SIZE):
        rolled += words[k : n + k] * _ODD[k]
    rolled, out = _mixed(rolled), []
    for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - first >= SIZE:
            own = rolled[first : end - SIZE + 1]
        else:
            own = _mixed((words[first:end] * _ODD[: end - first]).sum(keepdims=True)) if end > first else words[:0]
        out.append(np.unique(own, return_counts=True))
    return out


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Those of one text, by its words."""
    return shingle_sets([b" ".join(words)])[0]


def node_of(words: list[bytes]) -> bytes:
    """Identity of a text by its words; texts of equal words are exact copies."""
    return xxhash.xxh3_128_digest(b" ".join(words))


class Weights:
    """Inverse document frequencies: those of common shingles by hash, the rest alike."""

    def __init__(self, common: list[tuple[int, int]], n_kinds: int):
        rows = sorted((h & (2**64 - 1), df) for h, df in common)
        self.hashes = np.array([h for h, _ in rows], np.uint64)
        self.idf = np.log1p(1 / np.maximum(np.array([df for _, df in rows], float) / max(n_kinds, 1), COMMON))
        self.most = np.log1p(1 / COMMON)

    def of(self, sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(sh), self.most)
        if len(self.hashes) and len(sh):
            at = np.minimum(np.searchsorted(self.hashes, sh), len(self.hashes) - 1)
            known = self.hashes[at] == sh
            idf[known] = self.idf[at[known]]
        return counts * idf


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


class Sampler:
    """Improved consistent weighted sampling with draws from tables of the distributions."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n = samples
        self.mult = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        self.beta = rng.random(1 << 16).astype(np.float32)

    def sketch(self, flat: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(texts, samples) sample hashes of non-empty sets laid end to end."""
        starts = np.cumsum(lengths) - lengths
        log_w, mask = np.log(weights).astype(np.float32), np.uint64(0xFFFF)
        out = np.empty((len(lengths), self.n), np.uint64)
        for k in range(self.n):
            x = flat * self.mult[k]
            x ^= x >> np.uint64(31)
            r = self.r[(x & mask).astype(np.int64)]
            beta = self.beta[((x >> np.uint64(16)) & mask).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            a = self.log_c[((x >> np.uint64(32)) & mask).astype(np.int64)] - r * (t - beta + 1)
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            first = least[np.searchsorted(least, starts)]
            out[:, k] = _mixed(flat[first] + (t[first].astype(np.int64).view(np.uint64) + np.uint64(k + 1)) * _ODD[7])
        return out


# ---------------------------------------------------- common shingles


def _of_texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Distinct shingles, sorted, of each text of the first column that has some."""
    return [sh for sh, _ in shingle_sets([folded(t or "") for t in batch.column(0).to_pylist()]) if len(sh)]


def common_shingles(docs: DataFrame, text_col: str, n_docs: int) -> tuple[list[tuple[int, int]], int]:
    """(hash, kinds of texts) of all shingles in a share of COMMON of the texts or more, and the kinds of all texts.

    Texts are of one kind if their least shingle hash is the same.

    Two passes over all texts. The first counts shingles by slots of their
    hashes; a slot's count is no less than any of its shingles', so those of
    slots that reach the share hold all that do. The second counts the texts
    and kinds of these exactly. At most (mean distinct shingles of a text) / COMMON stay, and as
    many slots, whatever the corpus and the order of its texts.
    """
    spark, least = docs.sparkSession, COMMON * n_docs
    texts = docs.select(text_col)
    # A text has a shingle to a word, and a word has a byte and a space at least, some six bytes as a rule.
    mean = (texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / max(n_docs, 1) / 6
    slots = min(MOST_SLOTS, 1 << max(14, int(SLOTS_EACH * mean / COMMON).bit_length()))
    mask, piece = np.uint64(slots - 1), min(slots, 1 << 14)

    def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(slots, np.uint32)
        for batch in batches:
            place, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_of_texts(batch)]) & mask, return_counts=True)
            sums[place.astype(np.int64)] += n.astype(np.uint32)
        for i in np.flatnonzero(sums.reshape(-1, piece).any(axis=1)).tolist():
            data = pa.compress(sums[i * piece : (i + 1) * piece].view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())], names=["piece", "counts"])
        tidy()

    def hot_slots(group: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for data in group["counts"].to_pylist():
            total += np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * piece, "zstd", asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        return pa.table({"slot": pa.array(np.flatnonzero((total >= least) & (total > 0)) + group["piece"][0].as_py() * piece)})

    # A task for some thousands of texts: each sends all its slots.
    together = texts.coalesce(max(1, -(-n_docs // 4000)))
    found = materialize(together.mapInArrow(count_slots, "piece long, counts binary").groupBy("piece").applyInArrow(hot_slots, "slot long"), "dedup-slots")
    hot = np.zeros(slots, bool)
    hot[found.toArrow()["slot"].to_numpy()] = True
    held = spark.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, own, kinds, size = held.value, [], [], 0

        def out() -> pa.RecordBatch:
            h, kind = np.concatenate(own), np.repeat(np.array(kinds, np.uint64), [len(x) for x in own])
            _, first, n = np.unique(_mixed(h * _ODD[9] + kind), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(kind[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "kind", "n"])

        for batch in batches:
            for sh in _of_texts(batch):
                # Hash 0 stands for having any shingle.
                own.append(np.concatenate((np.zeros(1, np.uint64), sh[hot[(sh & mask).astype(np.int64)]])))
                kinds.append(sh[0])
                size += len(own[-1])
            if size > 1_000_000:
                yield out()
                own, kinds, size = [], [], 0
        if own:
            yield out()
        tidy()

    each = texts.mapInArrow(count, "h long, kind long, n long").groupBy("h", "kind").agg(F.sum("n").alias("n"))
    exact = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("h") == 0)), "dedup-common")
    out = {r["h"]: r["kinds"] for r in exact.collect()}
    n_kinds = out.pop(0, 0)
    discard(found, exact)
    return list(out.items()), n_kinds


# ---------------------------------------------------------- signatures


SIGNED = "doc_id long, text_key long, node binary, bands array<long>, weight double"


def signatures(docs: DataFrame, weights, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_key, node, bands, weight); a text without words has node null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), weights.value
        for batch in batches:
            texts = [folded(t or "") for t in batch.column(2).to_pylist()]
            nodes = [node_of(w) if (w := t.split()) else None for t in texts]
            sets = [s for s in shingle_sets(texts) if len(s[0])]
            bands, totals = [], []
            at = 0
            while at < len(sets):
                end, size = at, 0
                while end < len(sets) and (end == at or size + len(sets[end][0]) <= 80_000):
                    size += len(sets[end][0])
                    end += 1
                flat, counts = (np.concatenate(x) for x in zip(*sets[at:end], strict=True))
                weighed, sizes = idf.of(flat, counts), np.array([len(s[0]) for s in sets[at:end]])
                got = sampler.sketch(flat, weighed, sizes)
                rows = got.reshape(len(got), BANDS, ROWS)
                key = np.zeros(rows.shape[:2], np.uint64)
                for k in range(ROWS):
                    key = _mixed(key + rows[:, :, k] * _ODD[8 + k])
                key += np.arange(BANDS, dtype=np.uint64) * _ODD[20]
                bands += key.view(np.int64).tolist()
                totals += np.add.reduceat(weighed, np.cumsum(sizes) - sizes).tolist()
                at = end
            whole = iter(zip(bands, totals, strict=True))
            pairs = [next(whole) if n is not None else (None, None) for n in nodes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array([p[0] for p in pairs], schema.field(3).type), pa.array([p[1] for p in pairs], schema.field(4).type)], schema=schema)
            del texts, sets, bands, totals, whole, pairs, batch
        tidy()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return materialize(picked.mapInArrow(run, SIGNED), "signed")


# --------------------------------------------------------------- links


def _key(doc_id: Column, text_key: Column) -> Column:
    return F.xxhash64(doc_id, text_key)


def in_map(df: DataFrame, key: Column, keys: DataFrame, mark: str) -> DataFrame:
    """`df` with boolean column `mark`, true wherever `key` is among `keys` (column key), and seldom elsewhere.

    A bit map of the keys decides, KEY_BITS bits to a key and MOST_BITS at
    most; beyond that more rows are marked than need be, and none is missed.
    """
    bits = min(MOST_BITS, max(_BLOCK_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = lambda key: F.pmod(key, F.lit(bits))
    maps = keys.select(place(F.col("key")).alias("place")).groupBy(F.floor(F.col("place") / _BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(F.col("place") % _BLOCK_BITS).alias("map"))
    here, side = free_name(df, "map_place"), free_name(df, "map_side")
    maps = F.broadcast(maps.select(F.struct("*").alias(side)))
    joined = df.withColumn(here, place(key)).join(maps, F.floor(F.col(f"`{here}`") / _BLOCK_BITS) == F.col(f"`{side}`.block"), "left")
    at = F.col(f"`{here}`") % _BLOCK_BITS
    byte = F.conv(F.hex(F.substring(F.col(f"`{side}`.map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(mark, F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1, F.lit(False))).drop(here, side)


def split_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame]:
    """`docs` that may be among `keys` (key, text_key), with a struct (key, text_key) of the returned name, and those that aren't.

    Only some texts that aren't needed are shuffled beside those that are.
    """
    own, mark = free_name(docs, "row_key"), free_name(docs, "row_mark")
    text_key = F.xxhash64(f"`{text_col}`")
    keyed = docs.withColumn(own, F.struct(_key(F.col(f"`{id_col}`").cast("long"), text_key).alias("key"), text_key.alias("text_key")))
    marked = in_map(keyed, F.col(f"`{own}`.key"), keys, mark)
    return marked.where(F.col(f"`{mark}`")).drop(mark), own, marked.where(~F.col(f"`{mark}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def texts_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `needed` (node, ...), each node once, with the node's text."""
    keys = materialize(needed.join(nodes.select("node", _key(F.col("doc_id"), F.col("text_key")).alias("key"), "text_key"), "node"), "dedup-keys")
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    some, own, _ = split_rows(plain, keys, "id", "text")
    found = some.select(F.col(f"{own}.key").alias("key"), F.col(f"{own}.text_key").alias("text_key"), "text").join(keys, ["key", "text_key"])
    # Repeated rows lie where the join has put them, so this shuffles nothing.
    texts = materialize(found.dropDuplicates(["key", "text_key", "node"]).select(*needed.columns, "text"), "dedup-texts")
    discard(keys)
    return texts


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, weights, id_col: str, text_col: str, similar: float) -> DataFrame:
    """Pairs (a, b) whose texts have weighted Jaccard similarity of `similar` or more."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(needed, nodes, docs, id_col, text_col)
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "text_a", "b", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value

        @lru_cache(maxsize=16)
        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            sh, counts = shingle_sets([folded(text)])[0]
            return sh, idf.of(sh, counts)

        for batch in batches:
            a, ta, b, tb = (c.to_pylist() for c in batch.columns)
            keep = [similarity(vector(x), vector(y)) >= similar for x, y in zip(ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, keep, strict=True) if k], pa.binary()), pa.array([x for x, k in zip(b, keep, strict=True) if k], pa.binary())], names=["a", "b"])
            del a, ta, b, tb, batch
        vector.cache_clear()
        tidy()

    links = materialize(both.mapInArrow(run, "a binary, b binary"), "dedup-links", 128)
    discard(texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) of the links' nodes: the least node of each component.

    Each round takes the least label among neighbours, then the label's label,
    and is written, so a lost executor repeats no earlier round.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = near.join(labels, "node").select("node", F.least("label", "near").alias("low"), "label")
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = materialize(low.join(up, F.col("low") == F.col("at")).select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved")), "cc")
        moved = new.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]
        discard(labels)
        labels = new
        if not moved:
            discard(edges)
            out = labels.select("node", "label")
            out.written_at = labels.written_at
            return out


def sliced_join(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Bucket members (key, node, n, ...) with their bucket's row (key, n, ...), which is repeated for each slice of a large bucket."""
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    own = members.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int"))
    many = buckets.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("n")
    return own.join(many, ["key", "slice"]).drop("slice")


def leader_pairs(bucketed: DataFrame, similar: float) -> DataFrame:
    """Each bucket's members with its leader, as far as their weights may be of similar texts."""
    company = bucketed.groupBy("node").agg(F.sum("n").alias("company"))
    best = bucketed.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node", "weight")).alias("top"), F.max("n").alias("n"))
    leaders = materialize(best.select("key", "n", F.col("top.node").alias("leader"), F.col("top.weight").alias("most")), "dedup-leaders")
    able = F.least("weight", "most") >= (similar - SLACK) * F.greatest("weight", "most")
    pairs = sliced_join(bucketed, leaders).where(able & (F.col("node") != F.col("leader")))
    found = materialize(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "dedup-pairs")
    discard(leaders)
    return found


def mixed_members(bucketed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, n, weight, label, n_outside, outside) of buckets that hold several classes; outside: not of the largest."""
    label = F.coalesce(F.col("label"), F.col("node"))
    placed = bucketed.join(labels, "node", "left").select("key", "node", "n", "weight", label.alias("label"))
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("classes"), F.max("n").alias("n")).where("classes > 1")
    mixed = materialize(mixed.select("key", "n", F.col("main.label").alias("main"), (F.col("n") - F.col("main.m")).alias("n_outside")), "dedup-main")
    members = materialize(sliced_join(placed, mixed).withColumn("outside", F.col("label") != F.col("main")).drop("main"), "dedup-mixed")
    discard(mixed)
    return members


def reach(texts: DataFrame, weights, similar: float) -> DataFrame:
    """Rows (node, w, s) of (node, of, text): a text's weight, and the part of it in shingles that a candidate of another class has.

    What texts of two classes share is at most the lesser s, which bounds their
    similarity without comparing them. A text of which s is too little is
    similar to none outside its class and left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for batch in batches:
            sets = [(sh.view(np.int64), idf.of(sh, counts)) for sh, counts in shingle_sets([folded(t) for t in batch.column(2).to_pylist()])]
            hs, ws = pa.array([h for h, _ in sets], pa.list_(pa.int64())), pa.array([w.astype(np.float32) for _, w in sets], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.sum() for _, w in sets], pa.float64()), hs, ws], names=["node", "of", "w", "hs", "ws"])
            del sets, hs, ws, batch
        tidy()

    sets = texts.mapInArrow(run, "node binary, of long, w double, hs array<long>, ws array<float>")
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "dedup-sets")
    each = sets.select("id", "of", F.inline(F.arrays_zip("hs", "ws")))
    in_one = each.groupBy("hs").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low = high").select("hs")
    own = each.select("id", "hs", "ws").join(in_one, "hs", "left_semi").groupBy("id").agg(F.sum("ws").alias("own"))
    left = sets.select("id", "node", "w").join(own, "id", "left").select("node", "w", (F.col("w") - F.coalesce("own", F.lit(0.0))).alias("s"))
    able = materialize(left.where(F.col("s") >= F.col("w") * (similar - SLACK)), "dedup-able")
    discard(sets)
    return able


def closest_pairs(members: DataFrame, reached: DataFrame, done: DataFrame, similar: float) -> DataFrame:
    """Members outside their bucket's main class, each with the one in it that has least of its own."""
    near = members.join(reached, "node")
    top = materialize(near.where("not outside").groupBy("key").agg(F.max(F.struct(F.col("s") / F.col("w"), "node", "w", "s")).alias("top"), F.max("n").alias("n")), "dedup-top")
    most = F.least("s", "top.s")
    pairs = sliced_join(near.where("outside"), top).where(most >= (similar - SLACK) * (F.col("w") + F.col("top.w") - most))
    ordered = pairs.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    found = materialize(ordered.join(done, ["a", "b"], "left_anti"), "dedup-pairs")
    discard(top)
    return found


def _blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, out, all): a block of members outside a bucket's main class, and a block of all its members.

    Both sides of a bucket are dealt by tiles of TILE blocks, so a task gets
    TILE * TILE pairs of blocks at once, whatever the bucket.
    """
    ready = materialize(members.join(nodes.select("node", "bands"), "node"), "dedup-members")
    row = F.collect_list(F.struct("node", "label", "bands", "w", "s", "outside"))

    def blocks(some: DataFrame, name: str, own: str, other_name: str, other: str) -> DataFrame:
        placed = some.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col(own) / BLOCK)).cast("int"))
        others = F.sequence(F.lit(0), F.ceil(F.col(other) / (BLOCK * TILE)).cast("int") - 1)
        made = placed.groupBy("key", "block", "n", "n_outside").agg(row.alias(name))
        return made.select("key", name, F.floor(F.col("block") / TILE).cast("int").alias(f"{name}_tile"), F.explode(others).alias(f"{other_name}_tile"))

    out = blocks(ready.where("outside"), "out", "n_outside", "all", "n")
    both = out.join(blocks(ready, "all", "n", "out", "n_outside"), ["key", "out_tile", "all_tile"])
    return both.select("key", "out", "all")


def _compared(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[tuple[dict, dict]]:
    """Pairs of members of different classes that may be similar, each in the first bucket they share."""
    for batch in batches:
        for key, out, every in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            bands = np.array([m["bands"] for m in every], np.int64)
            w, s = (np.array([m[k] for m in every]) for k in "ws")
            for m in out:
                most = np.minimum(s, m["s"])
                same = bands == np.array(m["bands"], np.int64)
                may = most >= (similar - SLACK) * (w + m["w"] - most)
                may &= bands[np.arange(len(bands)), same.argmax(axis=1)] == key
                for j in np.flatnonzero(may):
                    x = every[j]
                    # Of two members that both stand outside, one brings the pair.
                    if x["label"] != m["label"] and (not x["outside"] or m["node"] < x["node"]):
                        yield m, x


def possible_nodes(members: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Members of which the weight lets them be similar to another class's member in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for m, x in _compared(batches, similar):
            found |= {m["node"], x["node"]}
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["node"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["node"])

    open_ = members.withColumns({"w": F.col("weight"), "s": F.col("weight")})
    return materialize(_blocks(open_, nodes).mapInArrow(run, "node binary").distinct(), "dedup-possible", 16)


def rest_pairs(members: DataFrame, nodes: DataFrame, reached: DataFrame, done: DataFrame, similar: float) -> DataFrame:
    """Pairs of different classes that share a bucket and may be similar; those in `done` left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[list[bytes]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for m, x in _compared(batches, similar):
            pairs.append(sorted((m["node"], x["node"])))
            if len(pairs) == 50_000:
                yield out()
                pairs.clear()
        yield out()

    found = _blocks(members.join(reached, "node"), nodes).mapInArrow(run, "a binary, b binary").distinct()
    return materialize(found.join(done, ["a", "b"], "left_anti"), "dedup-rest", 16)


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Rows (doc_id, text_key, class_id, alone, class), one for each of `docs`, written; class_id is the class's least doc_id.

    Only `class` tells classes apart: with null or repeated ids, several may
    have one class_id. Null, empty and wordless texts are alone. Repeated rows are copies of one
    text. A class of null ids only has a null class_id. Texts of fewer than
    five words are one shingle, so only copies of them are similar.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    weights = spark.sparkContext.broadcast(Weights(*common_shingles(docs, text_col, n_docs)))
    signed = signatures(docs, weights, id_col, text_col)
    some = F.min(F.struct("doc_id", "text_key"))
    nodes = signed.where("node is not null").groupBy("node").agg(some.alias("at"), F.any_value("bands").alias("bands"), F.any_value("weight").alias("weight"))
    nodes = materialize(nodes.select("node", "at.doc_id", "at.text_key", "bands", "weight"), "nodes")
    rows = nodes.select("node", "weight", F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-shared")
    bucketed = materialize(in_map(rows, F.col("key"), shared, "may").where("may").drop("may").join(shared, "key"), "buckets")
    pairs = leader_pairs(bucketed, similar)
    links = verified(pairs, nodes, docs, weights, id_col, text_col, similar)
    labels = components(links)
    members = mixed_members(bucketed, labels)
    possible = possible_nodes(members, nodes, similar)
    classed = possible.join(labels, "node", "left").select("node", F.xxhash64(F.coalesce("label", "node")).alias("of"))
    texts = texts_of(classed, nodes, docs, id_col, text_col)
    reached = reach(texts, weights, similar)
    discard(shared, possible, texts)
    used = [signed, nodes, bucketed, pairs, links, labels, members, reached]
    second = closest_pairs(members, reached, pairs, similar)
    more = verified(second, nodes, docs, weights, id_col, text_col, similar)
    used += [second, more]
    if more.take(1):
        links, pairs = links.union(more), pairs.union(second)
        labels = components(links)
        members = mixed_members(bucketed, labels)
        used += [labels, members]
    rest = rest_pairs(members, nodes, reached, pairs, similar)
    more = verified(rest, nodes, docs, weights, id_col, text_col, similar)
    used += [rest, more]
    if more.take(1):
        labels = components(links.union(more))
        used.append(labels)
    own = signed.select("doc_id", "text_key", "node").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    # Ids of a class meet as partial minima; wordless rows have no class.
    least = materialize(own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id")), "dedup-least")
    class_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    found = materialize(own.join(least, "class", "left").select("doc_id", "text_key", class_id, F.col("class").isNull().alias("alone"), "class"), "classes")
    discard(*used, least)
    return found


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """`docs` with one document of each class: that of the least id, then text hash.

    Null, empty and wordless texts all stay; of repeated rows one stays. All
    columns are returned, whatever their names. An empty table stays empty.
    """
    found = near_classes(docs, id_col=id_col, text_col=text_col, similar=similar)
    each = found.where("not alone").groupBy("class", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(each.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.sum("n").alias("n")).where("n > 1").select("class", "first"), "dedup-first")
    key = _key(F.col("doc_id"), F.col("text_key")).alias("key")
    several = found.join(first.select("class"), "class", "left_semi").select(key, "text_key").distinct()
    keepers = first.select("first.*").select(key, "text_key", F.lit(True).alias("kept"))
    marks = materialize(several.join(keepers, ["key", "text_key"], "left").select("key", "text_key", F.coalesce("kept", F.lit(False)).alias("kept")), "marks")
    discard(found, first)
    may, own, others = split_rows(docs, marks, id_col, text_col)
    mark = free_name(may, "dedup_mark")
    side = marks.select(F.struct("*").alias(mark))
    joined = may.join(side, (F.col(f"`{own}`.key") == F.col(f"`{mark}`.key")) & (F.col(f"`{own}`.text_key") == F.col(f"`{mark}`.text_key")), "left")
    untouched = joined.where(F.col(f"`{mark}`").isNull())
    kept = joined.where(F.col(f"`{mark}`.kept")).dropDuplicates([own])
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return others.unionByName(untouched.select(*cols)).unionByName(kept.select(*cols))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
