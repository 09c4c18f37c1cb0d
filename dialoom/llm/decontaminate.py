"""Benchmark decontamination by a generalised suffix automaton of the items.

The automaton holds every word sequence of every item. A document's words are
streamed through it; at each word the longest match that ends there is known.
A match of at least `window` words is an occurrence of one or more windows, and
its words are hit. An item shorter than the window counts as one window.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import extend, free_name, materialize, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to word bytes or spaces: words are runs of 0-9, a-z and bytes from 0x80.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Characters of items in one automaton; more items make further automata.
SHARD_CHARS = 2_000_000


def folded(text: str) -> bytes:
    """Its words, lower-cased, with spaces in place of all else."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def words_of(text: str) -> list[bytes]:
    return folded(text).split()


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each state."""

    window: int = 10
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The part of q that p's strings extended by w reach, as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def build(self, items: list[list[int]]) -> SuffixAutomaton:
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        owners: list[set[int]] = [set() for _ in range(n)]
        self.short: dict[int, list[int]] = {}
        for i, words in enumerate(items):
            v = 0
            for w in words:
                v = u = self.next[v][w]
                while u > 0 and i not in owners[u]:
                    owners[u].add(i)
                    u = self.link[u]
            if 0 < len(words) < self.window:
                self.short.setdefault(v, []).append(i)
        self.short_len = {v: len(items[x[0]]) for v, x in self.short.items()}
        #: For each state, the one of its longest strings' last `window` words.
        self.last_window = [0] * n
        #: For each state, itself or the next above that is a whole short item.
        self.near_short = [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.last_window[v] = self.last_window[up] or (v if self.length[v] >= self.window else 0)
            self.near_short[v] = v if v in self.short else self.near_short[up]
        self.owners = {v: frozenset(owners[v]) for v in set(self.last_window) - {0}}
        return self

    def stream(self, words: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Longest matches over `words`; adds hit spans [start, end) and the items that occur."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        for j, w in enumerate(words, base + 1):
            while w not in nxt[v]:
                v = link[v]
                if v < 0:
                    break
                size = length[v]
            if v < 0:
                v = size = 0
                continue
            v = nxt[v][w]
            size += 1
            if size >= window:
                spans.append((j - window, j))
                found |= self.owners[self.last_window[v]]
            u = self.near_short[v]
            while u:
                m = self.short_len[u]
                if m <= size:
                    spans.append((j - m, j))
                    found.update(self.short[u])
                u = self.near_short[link[u]]


class Matcher:
    """The automaton with its vocabulary and the word pairs of the items."""

    def __init__(self, items: list[tuple[str, str]], window: int = 10):
        self.vocab: dict[bytes, int] = {}
        parsed = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)] for _, text in items]
        self.names = [name for (name, _), words in zip(items, parsed, strict=True) if words]
        parsed = [x for x in parsed if x]
        self.automaton = SuffixAutomaton(window).build(parsed)
        self.least = min((min(len(x), window) for x in parsed), default=window)
        n = max(len(self.vocab), 1)
        self.pairs = np.unique(np.array([a * n + b for x in parsed for a, b in zip(x, x[1:], strict=False)], np.int64))
        self.n = n

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that can hold a window: every neighbouring pair stands in an item.

        Elsewhere no match is longer than one word, so the automaton restarts.
        """
        if self.least < 2:
            return [(0, len(ids))]
        if len(ids) < self.least or not len(self.pairs):
            return []
        key = ids[:-1] * self.n + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        good = (self.pairs[at] == key) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.least - 1
        return list(zip(starts[keep].tolist(), (ends[keep] + 1).tolist(), strict=True))

    def match(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in `text`; hit spans in words, merged and ascending; ids of items that occur."""
        words = words_of(text) if text else []
        if not words or not self.names:
            return len(words), [], set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in self._runs(ids):
            self.automaton.stream(ids[a:b].tolist(), a, spans, found)
        return len(words), merged(spans), {self.names[i] for i in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans of `text`."""
    if not spans:
        return []
    ends = {a for a, _ in spans} | {b - 1 for _, b in spans}
    at = {i: m.span() for i, m in enumerate(WORD.finditer(text.translate(_LOWER))) if i in ends}
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string())), ("cut", pa.string())])
FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,cut:string>"


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """`text` without its word spans."""
    if not spans:
        return text
    at, pieces = 0, []
    for a, b in char_spans(text, spans):
        pieces.append(text[at:a])
        at = b
    return "".join([*pieces, text[at:]])


def cut_out(matcher: Matcher, text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without its spans, and without what the words beside a cut make together, until nothing matches."""
    while spans:
        text = cut(text, spans)
        spans = matcher.match(text)[1]
    return text


def _one_pass(docs: DataFrame, text_col: str, name: str, items: list[tuple[str, str]], window: int, cutting: bool = False) -> DataFrame:
    """`docs` with struct `name`; `cut`, the text without its spans, is made only on demand and where there are any."""
    held = docs.sparkSession.sparkContext.broadcast(Matcher(items, window))
    place = docs.columns.index(text_col)

    def compute():
        matcher = held.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text in batch.column(place).to_pylist():
                n, spans, found = matcher.match(text)
                rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(found), "cut": cut_out(matcher, text, spans) if cutting and spans else None})
            return [pa.array(rows, _FOUND)]

        return work

    return extend(docs, f"`{name}` {FOUND}", compute)


def _chosen(items: DataFrame, item_id: str, item_text: str, shard_chars: int) -> tuple[DataFrame, int]:
    """Items with text as (i, t), and into how many automata they go."""
    chosen = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    total = chosen.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    return chosen, -(-total // shard_chars) or 1


def match_items(docs: DataFrame, items: DataFrame, *, name: str = "matched", text_col: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = 10, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """`docs` with a struct column `name`: n_words, hit spans in words, ids of items with an occurring window.

    Null and wordless texts match nothing. Items without a word are left out;
    an item's null id is the empty string; rows that repeat an item count as
    one. Other columns stay as they are; if `name` is taken, the new column
    has underscores before it. Items of up to
    `shard_chars` characters make one broadcast automaton; a larger benchmark
    is dealt by a hash of its text into automata of that size, one pass each,
    whose spans and items are united.
    """
    name = free_name(docs, name)
    chosen, shards = _chosen(items, item_id, item_text, shard_chars)
    if shards == 1:
        return _one_pass(docs, text_col, name, [tuple(r) for r in chosen.collect()], window)
    out = docs
    parts = [free_name(docs, f"{name}_{k}") for k in range(shards)]
    for k, part in enumerate(parts):
        rows = chosen.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == k).collect()
        out = materialize(_one_pass(out, text_col, part, [tuple(r) for r in rows], window), "items")
    spans = F.array_sort(F.concat(*[F.col(f"`{p}`.spans") for p in parts]))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    # Spans in order are joined where they touch: the last one grows or the next begins.
    fused = F.aggregate(spans, empty, lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(s))))
    united = F.struct(F.col(f"`{parts[0]}`.n_words").alias("n_words"), fused.alias("spans"), F.array_sort(F.array_distinct(F.concat(*[F.col(f"`{p}`.items") for p in parts]))).alias("items"), F.lit(None).cast("string").alias("cut"))
    return out.withColumn(name, united).drop(*parts)


def _cut_once(found: DataFrame, text_col: str, name: str) -> DataFrame:
    """`found` with the spans of struct `name` cut from its texts."""
    text_at, hit_at, made = found.columns.index(text_col), found.columns.index(name), free_name(found, "cut")

    def compute():
        rows = lambda b: zip(b.column(text_at).to_pylist(), b.column(hit_at).to_pylist(), strict=True)
        return lambda b: [pa.array([cut(t, [(s["start"], s["end"]) for s in m["spans"]]) for t, m in rows(b)], pa.string())]

    return extend(found, f"`{made}` string", compute).select(*[F.col(f"`{made}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in found.columns])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = 10, max_coverage: float = 0.5,
                  item_id: str = "item_id", item_text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """`docs` without benchmark passages: matching spans are cut from the text.

    Every span of `window` words or more (or a whole shorter item) is removed;
    a document of which more than `max_coverage` of the words were hit goes
    entirely. What the words beside a cut make together is cut as well, until
    nothing matches. Texts without a hit are returned unchanged, null ones included.
    With one automaton, matching and cutting are one pass of one worker. With
    more, cut texts are matched again in a further round, until none is hit:
    in each round all spans of all items go at once, so the result is the same.
    """
    name = free_name(docs, "matched")
    chosen, shards = _chosen(items, item_id, item_text, shard_chars)
    hit = F.aggregate(F.col(f"`{name}`.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    few = hit <= F.col(f"`{name}`.n_words") * max_coverage
    if shards == 1:
        kept = _one_pass(docs, text_col, name, [tuple(r) for r in chosen.collect()], window, True).where(few)
        text = F.when(hit > 0, F.col(f"`{name}`.cut")).otherwise(F.col(f"`{text_col}`")).alias(text_col)
        return kept.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    cols = [F.col(f"`{c}`") for c in docs.columns]

    def match(some: DataFrame) -> DataFrame:
        return materialize(match_items(some, items, name=name, text_col=text_col, window=window, item_id=item_id, item_text=item_text, shard_chars=shard_chars), "matched")

    kept = match(docs).where(few)
    clean = kept.where(hit == 0).select(*cols)
    while (left := kept.where(hit > 0)).take(1):
        kept = match(_cut_once(left, text_col, name).select(*cols))
        clean = clean.union(kept.where(hit == 0).select(*cols))
    return clean


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_items(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("matched.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("matched.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("matched.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("matched.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple]:
    """The contract by direct search, for tests: n_words, n_hit, n_items, digest, contaminated."""
    fold = lambda t: WORD.findall((t or "").translate(_LOWER))
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        words = fold(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(name)
    out = []
    for text in texts:
        words, hit, found = fold(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), digest, bool(hit)))
    return out
