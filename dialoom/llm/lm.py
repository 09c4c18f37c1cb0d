"""Language-model scores by a weighted backoff automaton over all n-grams of the training texts.

A context of known words is a state, a word seen after it an arc, and the next
shorter context is where its failure arc leads. All n-grams up to `ORDER` words
are in the model, each as often as it was seen; nothing is pruned at any size.
Unigrams are smoothed by adding one, longer n-grams by a Dirichlet prior on
what the shorter context gives: p(w|h) = (c(hw) + k p(w|h')) / (c(h) + k), so an
unseen word costs k / (c(h) + k) on the failure arc, and each state's
probabilities sum to one.

No task holds the model. Texts are read once, into chunks of word numbers that
are written. Each chunk sends its distinct n-grams, as sorted 64-bit keys or
less, to the parts of the key space; a part adds up what was seen in training
and sends the sums back in the order asked. With them a chunk builds the part
of the automaton that its texts can reach (`Arcs`): states, arcs, failure arcs
and their weights. Its tokens, in lanes side by side, walk it once from left to
right and carry their states. `Automaton` is the same model in memory, for
small corpora.

Keys of words have 64 bits, or as many as leave one chance in thousands that
any two words of the corpus share one; those of longer n-grams have `SPARE` bits more
than the corpus has n-grams, so one in 65,536 may share its key, at any size.
A task holds a chunk (`CHUNK` tokens, or one text if that is longer) or a part
(some `PART` n-grams).
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, sliced, table, tidy, worker_cache

#: The end token as a word: words hold no white space.
END = "\n"
ORDER = 3
#: Weight of what the shorter context gives, by the length of the context.
PRIOR = (1000.0, 4.0)
#: Tokens taken together in a task; n-grams, as chunks have them, to a part.
CHUNK, PART = 1_000_000, 3_000_000
#: Bytes of text to a token, about; bits of a key beyond those that count the corpus's n-grams.
TOKEN_BYTES, SPARE = 6.4, 16


def tokens(text: str | None) -> list[bytes]:
    """Words in lower-case ASCII, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Automaton:
    """The model of `texts` in memory: states with arcs, failure arcs and their weights; state 0 is the root."""

    def __init__(self, texts: Iterable[str | None], prior: tuple[float, ...] = PRIOR):
        grams: Counter[tuple[bytes, ...]] = Counter()
        for text in texts:
            own = tokens(text)
            grams.update(tuple(own[i : i + k]) for k in range(1, len(prior) + 2) for i in range(len(own) - k + 1))
        words = [g for g in grams if len(g) == 1]
        self.n_tokens, self.n_words = sum(grams[g] for g in words), len(words)
        self.unseen = math.log10(1 / (self.n_tokens + self.n_words + 1))
        # The end opens no context.
        self.states = {(): 0} | {g: i for i, g in enumerate((g for g in grams if len(g) <= len(prior) and g[-1] != b"\n"), 1)}
        self.fail = [0] * len(self.states)
        self.weight = [0.0] * len(self.states)
        for g, s in self.states.items():
            if g:
                self.fail[s] = self.states[g[1:]]
                self.weight[s] = math.log10(prior[len(g) - 1] / (grams[g] + prior[len(g) - 1]))
        self.arcs: dict[tuple[int, bytes], float] = {}
        for g in sorted(grams, key=len):
            *context, w = g
            s = self.states[tuple(context)]
            if s:
                k = prior[len(context) - 1]
                self.arcs[s, w] = math.log10((grams[g] + k * 10 ** self.cost(self.fail[s], w)) / (grams[tuple(context)] + k))
            else:
                self.arcs[0, w] = math.log10((grams[g] + 1) / (self.n_tokens + self.n_words + 1))

    def cost(self, state: int, word: bytes) -> float:
        """log10 probability of `word` in `state`."""
        total = 0.0
        while (state, word) not in self.arcs:
            if not state:
                return total + self.unseen
            total, state = total + self.weight[state], self.fail[state]
        return total + self.arcs[state, word]

    def walk(self, words: list[bytes]) -> float:
        """log10 probability of a text's tokens."""
        context: tuple[bytes, ...] = ()
        total = 0.0
        for w in words:
            total += self.cost(self.states[context], w)
            context = (*context, w)[-len(PRIOR) :]
            while context not in self.states:
                context = context[1:]
        return total


# ------------------------------------------------------------------ codecs


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers under 256**width, compressed byte by byte."""
    return pa.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unplanes(data: bytes, n: int, width: int = 4) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data, width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _low_bytes(bits: int) -> int:
    """Bytes of a key that are stored as they are; the rest is small differences of the sorted keys, under 2**32."""
    return max(bits - 24, 16) // 8 if bits <= 48 else -(-(bits - 32) // 8)


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of `bits` bits."""
    low = _low_bytes(bits)
    high = _planes(np.diff(keys >> np.uint64(8 * low), prepend=np.uint64(0)))
    return len(high).to_bytes(4, "little") + high + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].T.tobytes()


def unpack_keys(data: bytes, n: int, bits: int) -> np.ndarray:
    low, size = _low_bytes(bits), int.from_bytes(data[:4], "little")
    out = np.cumsum(_unplanes(data[4 : 4 + size], n), dtype=np.uint64) << np.uint64(8 * low)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :low] = np.frombuffer(data, np.uint8, low * n, 4 + size).reshape(low, n).T
    return out | raw.reshape(-1).view("<u8")


# ------------------------------------------------------------------ chunks

CHUNKS = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("n_train", pa.int64()), ("docs", pa.binary()), ("no_id", pa.binary()), ("train", pa.binary()), ("sizes", pa.binary()), ("n_words", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])
CHUNKS_DDL = "chunk long, n long, n_train long, docs binary, no_id binary, train binary, sizes binary, n_words long, words binary, ids binary"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def chunks_of(texts: DataFrame, tasks: int, word_bits: int, chunk: int) -> DataFrame:
    """Rows of some `chunk` tokens of (doc_id, train, text), whole texts, written: the composition stays whatever is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("", dict)
        at = TaskContext.get().partitionId() << 32
        names: dict[bytes, int] = {}
        ids, sizes, docs, train = array("i"), array("i"), [], []

        def full() -> pa.RecordBatch:
            flat, size = np.frombuffer(ids, np.int32), np.frombuffer(sizes, np.int32)
            learnt = np.array(train, bool)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) >> np.uint64(64 - word_bits)
            row = (at, len(flat), int(size[learnt].sum()), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "u1").tobytes(), learnt.tobytes(), size.astype("<u4").tobytes(), len(names), _planes(hashes, 8), _planes(flat))
            return _columns([row], CHUNKS)

        for batch in batches:
            for doc, learn, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = tokens(text)
                ids.extend([names.setdefault(w, len(names)) for w in own])
                sizes.append(len(own))
                docs.append(doc)
                train.append(learn)
                if len(ids) >= chunk:
                    yield full()
                    at += 1
                    names, ids, sizes, docs, train = {}, array("i"), array("i"), [], []
        if docs:
            yield full()
        names, ids = {}, array("i")
        tidy()

    return materialize(texts.coalesce(tasks).mapInArrow(run, CHUNKS_DDL), "lm-chunks")


_A, _B, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first and of their last words."""
    x = prefix * _A + suffix * _B + _M1
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Chunk:
    """A chunk's words, and the keys of the n-grams that start at its tokens."""

    def __init__(self, row: dict, bits: int):
        n = row["n"]
        self.words = _unplanes(row["words"], row["n_words"], 8)
        self.ids = _unplanes(row["ids"], n).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.train = np.frombuffer(row["train"], bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.sorted, self.rank = np.unique(self.words, return_inverse=True)
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(n)
        #: For each size above one: where such n-grams start, and their keys.
        self.places, self.keys = [], []
        level = self.words[self.ids]
        for size in range(2, ORDER + 1):
            level = _joined(level[:-1], level[1:])
            at = np.flatnonzero(left[: len(level)] >= size)
            self.places.append(at)
            self.keys.append(level[at] >> np.uint64(64 - bits))

    def token_train(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)


def _bounds(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part begins among sorted keys, and the end: parts share the key space evenly."""
    part = (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


ASKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("n_grams", pa.int64()), ("grams", pa.binary()), ("gram_counts", pa.binary())])
ASKED_DDL = "part long, chunk long, n_words long, words binary, word_counts binary, n_grams long, grams binary, gram_counts binary"
TOLD = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("known", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("n_grams", pa.int64()), ("grams", pa.binary())])
TOLD_DDL = "part long, chunk long, known long, n_words long, words binary, n_grams long, grams binary"


def counts_of(chunks: DataFrame, word_bits: int, bits: int, parts: int) -> DataFrame:
    """Rows (part, chunk, ...): how often training has each n-gram of a chunk, in the order of its keys; `known`: words it has, told once a part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)
        for batch in batches:
            for row in (r for b in sliced([batch], 1) for r in b.to_pylist()):
                own = _Chunk(row, bits)
                learnt = own.token_train()
                seen = np.bincount(own.rank[own.ids], learnt, len(own.sorted)).astype(np.int64)
                # The last bit says whether it is seen in training, so plain sorting brings equal keys and their counts together.
                marked = np.concatenate([k << np.uint64(1) | learnt[at].astype(np.uint64) for at, k in zip(own.places, own.keys, strict=True)])
                marked.sort()
                keys = marked >> np.uint64(1)
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first) if len(first) else first
                keys = keys[first]
                a, b = _bounds(own.sorted, word_bits, parts), _bounds(keys, bits, parts)
                rows = []
                for p in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
                    w, g = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                    rows.append((p, row["chunk"], w.stop - w.start, pack_keys(own.sorted[w], word_bits), _planes(seen[w]), g.stop - g.start, pack_keys(keys[g], bits), _planes(counts[g])))
                    if len(rows) == 64:
                        yield _columns(rows, ASKED)
                        rows = []
                yield _columns(rows, ASKED)
                del own, learnt, marked, keys, counts
            del batch
        tidy()

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()

        def summed(kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
            """Sums in the order of the rows' keys, and of each distinct key."""
            keys = np.concatenate([unpack_keys(r[f"{kind}s"], r[f"n_{kind}s"], width) for r in rows])
            counts = np.concatenate([_unplanes(r[f"{kind}_counts"], r[f"n_{kind}s"]) for r in rows])
            if not len(keys):
                return counts, counts
            order = np.argsort(keys)
            keys = keys[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            sums = np.add.reduceat(counts[order], np.flatnonzero(new))
            out = np.empty(len(keys), np.uint64)
            out[order] = sums[np.cumsum(new) - 1]
            return out, sums

        (words, distinct), (grams, _) = summed("word", word_bits), summed("gram", bits)
        known = int((distinct > 0).sum())
        out, w, g = [], 0, 0
        for r in rows:
            nw, ng = r["n_words"], r["n_grams"]
            out.append((r["part"], r["chunk"], known, nw, _planes(words[w : w + nw]), ng, _planes(grams[g : g + ng])))
            known, w, g = 0, w + nw, g + ng
        del rows, words, grams
        tidy()
        return pa.Table.from_batches([_columns(out, TOLD)])

    return materialize(chunks.mapInArrow(ask, ASKED_DDL).groupBy("part").applyInArrow(add, TOLD_DDL), "lm-counts")


SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Arcs:
    """The part of the automaton that a chunk's texts can reach, as arrays.

    State 0 is the root, state 1 + w the context of word w; longer contexts
    follow by length. All arcs are one sorted array of state * words + word,
    with log10 probabilities and the states they lead to. Where a state has no
    arc for a word, its failure arc adds its weight and hands the word to the
    next shorter context; the root has an arc for every word.
    """

    def __init__(self, own: _Chunk, word_counts: np.ndarray, gram_counts: np.ndarray, n_tokens: int, n_words: int):
        self.starts, self.n = own.starts, len(own.sorted)
        self.word = own.rank[own.ids].astype(np.int32)
        seen = word_counts.astype(np.int64)
        self.root = np.log10((seen + 1.0) / (n_tokens + n_words + 1))
        self.first = np.where(seen > 0, np.arange(1, self.n + 1), 0).astype(np.int32)
        fail, weight = [np.zeros(1 + self.n, np.int32)], [np.concatenate(([0.0], np.log10(PRIOR[0] / (seen + PRIOR[0]))))]
        keys, logs, to, states = [], [], [], 1 + self.n
        # Of the n-gram that starts at each token: its count, its state as a context, its arc's log10 probability.
        count, state, log = seen[self.word], self.first[self.word], self.root[self.word]
        counts = _in_place(own, gram_counts)
        for size in range(2, ORDER + 1):
            at, c = own.places[size - 2], counts.pop(0)
            at, c = at[c > 0], c[c > 0]
            last = self.word[at + size - 1]
            k = PRIOR[size - 2]
            # An n-gram seen in training has its last words seen there, too: their arc is the one that failure would lead to.
            c = c.astype(np.int64)
            p = np.log10((c + k * 10.0 ** log[at + 1]) / (count[at] + k))
            key, one, same = np.unique(state[at].astype(np.int64) * self.n + last, return_index=True, return_inverse=True)
            shorter = state[at + 1]
            keys.append(key)
            logs.append(p[one])
            if size < ORDER:
                new = np.arange(states, states + len(key), dtype=np.int32)
                fail.append(shorter[one])
                weight.append(np.log10(PRIOR[size - 1] / (c[one] + PRIOR[size - 1])))
                to.append(new)
                states += len(key)
                count, state, log = (np.zeros(len(self.word), kind) for kind in (np.int64, np.int32, float))
                count[at], state[at], log[at] = c, new[same], p
            else:
                to.append(shorter[one])
        # A key beyond all others ends the search.
        self.keys, self.logs, self.to = np.concatenate([*keys, [1 << 62]]), np.concatenate([*logs, [0.0]]), np.concatenate([*to, np.zeros(1, np.int32)])
        self.fail, self.weight = np.concatenate(fail), np.concatenate(weight)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of words in states, side by side, and the states after them."""
        cost, out, after = np.zeros(len(word)), self.root[word], self.first[word]
        state, left = state.copy(), np.flatnonzero(state)
        while len(left):
            key = state[left].astype(np.int64) * self.n + word[left]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            here, at = left[hit], at[hit]
            out[here], after[here] = self.logs[at], self.to[at]
            left = left[~hit]
            cost[left] += self.weight[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        return cost + out, after

    def walk(self) -> np.ndarray:
        """log10 probability of each token: one traversal from left to right, which carries the state.

        The tokens are cut into lanes that walk side by side. A state depends on
        the last ORDER - 1 words only, so a lane that begins within a text takes
        those first.
        """
        n, begins = len(self.word), np.zeros(len(self.word) + 1, bool)
        begins[self.starts] = True
        lanes = max(1, min(LANES, n // 64))
        width = -(-n // lanes)
        at = np.arange(0, n, width)
        text = self.starts[np.searchsorted(self.starts, at, side="right") - 1]
        state, out = np.zeros(len(at), np.int32), np.empty(n)
        for back in range(ORDER - 1, 0, -1):
            within = np.flatnonzero(at - back >= text)
            state[within] = self.step(state[within], self.word[at[within] - back])[1]
        for _ in range(width):
            at, state = at[at < n], state[: np.count_nonzero(at < n)]
            state[begins[at]] = 0
            out[at], state = self.step(state, self.word[at])
            at = at + 1
        return out


#: Stretches of a chunk that are walked side by side, at most.
LANES = 8192


def _in_place(own: _Chunk, gram_counts: np.ndarray) -> list[np.ndarray]:
    """How often training has the n-gram at each of the chunk's places, by size, from counts in the order of the keys."""
    every = np.concatenate(own.keys)
    counts = np.zeros(len(every), np.int64)
    if len(every):
        order = np.argsort(every)
        keys = every[order]
        counts[order] = gram_counts.astype(np.int64)[np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))]
    own.keys.clear()  # of no use any more
    return [np.array(c, np.uint32) for c in np.split(counts, np.cumsum([len(at) for at in own.places])[:-1])]


def walked(arcs: Arcs) -> list[np.ndarray]:
    """For each text: known tokens, log10 probability by words alone, and along the automaton."""
    total = np.add.reduceat(arcs.walk(), arcs.starts)
    known = (arcs.first > 0)[arcs.word].astype(np.int64)
    return [np.add.reduceat(known, arcs.starts), np.add.reduceat(arcs.root[arcs.word], arcs.starts), total]


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, part: int = PART, spare: int = SPARE) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows where `train` is true.

    A null `train` is false. A null or empty text is the end token alone.
    Repeated rows count and are scored each by itself; null ids stay null;
    other columns, whatever their names, are not read. No rows give no rows;
    without training rows every token is unknown. `spare` bits more than count
    the corpus's n-grams are in their keys; 63 make keys as wide as those of words.
    """
    # An end token for each text, as many bytes as a word has.
    n_bytes = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + TOKEN_BYTES), F.lit(0.0)).alias("n")).first()["n"]
    about = max(1, math.ceil(n_bytes / TOKEN_BYTES))
    tasks, parts = math.ceil(about / chunk), math.ceil(1.7 * about / part)
    # Tokens take two bytes at least, so there are fewer than n_bytes of them.
    word_bits, bits = min(64, max(40, 2 * about.bit_length() + 4)), min(63, max(40, about.bit_length() + 1 + spare))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    chunks = chunks_of(texts, tasks, word_bits, chunk)
    told = counts_of(chunks, word_bits, bits, parts)
    n_tokens = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    n_words = told.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]

    def walk(rows: pa.Table, counts: pa.Table) -> pa.Table:
        worker_cache("", dict)
        if not len(rows):
            return SCORED.empty_table()
        row = rows.to_pylist()[0]
        own = _Chunk(row, bits)
        ids = pa.array(np.frombuffer(row["docs"], "<i8"), mask=np.frombuffer(row["no_id"], bool))
        train, sizes = own.train, own.sizes
        parts_ = sorted(counts.to_pylist(), key=lambda r: r["part"])
        words, grams = (np.concatenate([_unplanes(r[f"{x}s"], r[f"n_{x}s"]) for r in parts_]) for x in ("word", "gram"))
        del row, parts_
        arcs = Arcs(own, words, grams, n_tokens, n_words)
        del own, words, grams  # the walk needs the arcs only
        known, base, total = walked(arcs)
        out = pa.table([ids, pa.array(train), pa.array(sizes), pa.array(known), pa.array(base), pa.array(total)], schema=SCORED)
        del arcs
        tidy()
        return out

    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(walk, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, ~held_out(F.col("doc_id")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
