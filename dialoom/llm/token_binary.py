"""Token ids in binary shards: patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. Its layout, little-endian:

    magic "PFR1" | n_docs u32 | n_blocks u32 | block_size u32 | n_values u64
    doc ids i64[n_docs] | doc id is null u8[n_docs] | ids per document u64[n_docs]
    block starts u64[n_blocks + 1], bytes from the first block
    blocks: minimum u32 | width u8 | exceptions u16 | packed words u32[32 * width]
            | exception positions u16[] | exception values u32[]

Each block subtracts its minimum and packs the differences at the width that
holds `percentile` of them; larger ones are stored whole in the exception list.
The start index gives any range of ids without decoding the blocks before it.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.common import fresh_path, materialize, release, table, tidy, worker_cache

MAGIC = b"PFR1"
BLOCK = 1024
LANES = 32
HEAD = struct.Struct("<4sIIIQ")
BLOCK_HEAD = struct.Struct("<IBH")

MANIFEST = "file string, part int, seq int, n_docs long, n_values long, bytes long"
DECODED = "file string, pos long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- the codec


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value, 0 for 0."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values of `width` bits -> (k, LANES * width) words."""
    k = len(values)
    rows = values.astype(np.uint64).reshape(k, BLOCK // LANES, LANES)
    out = np.zeros((k, width + 1, LANES), np.uint64)
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        moved = rows[:, i] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return out[:, :width].astype("<u4").reshape(k, LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(k, LANES * width) words -> (k, BLOCK) values."""
    k = len(words)
    padded = np.zeros((k, width + 1, LANES), np.uint64)
    padded[:, :width] = words.reshape(k, width, LANES)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((k, BLOCK // LANES, LANES), np.uint32)
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        both = padded[:, word] | (padded[:, word + 1] << np.uint64(32))
        out[:, i] = (both >> np.uint64(shift)) & mask
    return out.reshape(k, BLOCK)


def encode_blocks(full: np.ndarray, percentile: float) -> list[bytes]:
    """Bytes of each block of `full`, (blocks, BLOCK)."""
    low = full.min(axis=1)
    diff = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = _bits(np.partition(diff, at, axis=1)[:, at])
    over = diff >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    counts = over.sum(axis=1)
    packed: list[bytes] = [b""] * len(full)
    for width in np.unique(widths):
        if width:
            group = np.flatnonzero(widths == width)
            for i, words in zip(group, _pack(np.where(over[group], 0, diff[group]), int(width)), strict=True):
                packed[i] = words.tobytes()
    out = []
    for i, body in enumerate(packed):
        where = np.flatnonzero(over[i]) if counts[i] else np.zeros(0, np.int64)
        out.append(BLOCK_HEAD.pack(int(low[i]), int(widths[i]), int(counts[i])) + body + where.astype("<u2").tobytes() + diff[i][where].astype("<u4").tobytes())
    return out


def encode_values(values: np.ndarray, percentile: float = 0.95, together: int = 256) -> tuple[np.ndarray, bytes]:
    """Block starts (one more than blocks) and the blocks' bytes, some blocks at a time."""
    n_blocks = -(-len(values) // BLOCK)
    blocks: list[bytes] = []
    for first in range(0, n_blocks, together):
        part = values[first * BLOCK : (first + together) * BLOCK]
        full = np.full(-(-len(part) // BLOCK) * BLOCK, part[-1], np.uint32)
        full[: len(part)] = part
        blocks += encode_blocks(full.reshape(-1, BLOCK), percentile)
    starts = np.zeros(n_blocks + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=starts[1:])
    return starts, b"".join(blocks)


def shard_parts(doc_ids: list[int | None], ids: list[np.ndarray], percentile: float = 0.95) -> list[bytes]:
    """One shard's bytes, in parts; `ids` are the documents' id arrays in order, and are emptied."""
    lengths = np.array([len(x) for x in ids], "<u8")
    flat = np.concatenate(ids).astype(np.uint32, copy=False) if ids else np.zeros(0, np.uint32)
    ids.clear()
    starts, blocks = encode_values(flat, percentile)
    return [
        HEAD.pack(MAGIC, len(lengths), len(starts) - 1, BLOCK, len(flat)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        lengths.tobytes(),
        starts.tobytes(),
        blocks,
    ]


def encode_shard(doc_ids: list[int | None], ids: list[np.ndarray], percentile: float = 0.95) -> bytes:
    """One shard's bytes; `ids` are the documents' id arrays in order."""
    return b"".join(shard_parts(doc_ids, list(ids), percentile))


class Shard:
    """Random access to one shard's ids through its block index."""

    def __init__(self, data: bytes):
        self.data = data
        magic, self.n_docs, self.n_blocks, block, self.n_values = HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a PFR1 shard")
        at = HEAD.size
        raw = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        null = np.frombuffer(data, "u1", self.n_docs, at)
        at += self.n_docs
        self.lengths = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_blocks + 1, at).astype(np.int64)
        self.base = at + 8 * (self.n_blocks + 1)
        self.doc_ids = [None if x else int(d) for d, x in zip(raw, null, strict=True)]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Values of blocks first..last-1, blocks of one width unpacked together."""
        heads = [BLOCK_HEAD.unpack_from(self.data, self.base + int(self.starts[i])) for i in range(first, last)]
        out = np.zeros((last - first, BLOCK), np.uint32)
        widths = np.array([h[1] for h in heads], np.int64)
        body = self.base + self.starts[first:last] + BLOCK_HEAD.size
        for width in np.unique(widths):
            if width:
                group = np.flatnonzero(widths == width)
                words = np.stack([np.frombuffer(self.data, "<u4", LANES * int(width), int(body[i])) for i in group])
                out[group] = _unpack(words, int(width))
        for i, (low, width, count) in enumerate(heads):
            if count:
                at = int(body[i]) + 4 * LANES * width
                where = np.frombuffer(self.data, "<u2", count, at)
                out[i, where] = np.frombuffer(self.data, "<u4", count, at + 2 * count)
            out[i] += np.uint32(low)
        return out.reshape(-1)

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_values if stop is None else min(stop, self.n_values)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK : stop - first * BLOCK]


# ------------------------------------------------------------ the tokenizer

#: A stop or comma between a letter or digit of Latin-1 and a space or the end is a piece of its own.
_STOP = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,])( |\n|$)"
#: Marks of pieces that no space stands before: a stop, the start of a line.
_IS_STOP, _IS_LINE = "\x01", "\x03"


def piecewise(tok: dict) -> bool:
    """Whether a tokenizer parts texts at single spaces, stops and line ends as `PieceEncoder` relies on."""
    pre, model = tok.get("pre_tokenizer") or {}, tok.get("model") or {}
    plain = not tok.get("normalizer") and not tok.get("truncation") and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return bool(plain and model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True))


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A byte-level pre-tokenizer attaches one space to the word after it, and
    parts a word from a stop or comma after it and from a line's end. So a
    text's ids are those of its words, stops and line starts in order, except
    where white space runs are longer or an added token stands in the text:
    such texts are encoded whole, and so is every text if the tokenizer is of
    another kind. Short words are remembered, up to `limit`, then anew.
    """

    #: Words up to this length come again; most longer ones don't, and aren't remembered.
    SHORT = 9

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_piece = piecewise(json.loads(self.tok.to_str()))
        self.limit = limit
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.opens = {lead: np.zeros(max(vocab.values()) + 1, bool) for lead in " \n"}
        for lead, mark in ((" ", "Ġ"), ("\n", "Ċ")):
            self.opens[lead][[i for w, i in vocab.items() if w[:1] == mark]] = True
        self.seen: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str], lead: str) -> Iterator[bytes]:
        """Ids of words after `lead`, many to a call: each starts where an id starts with `lead`."""
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        joined = ["".join([lead + w for w in g]) for g in groups]
        for group, found in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.opens[lead][ids])
            if len(cuts) != len(group):
                yield from (self.whole(lead + w).tobytes() for w in group)
                continue
            data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
            yield from [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of marked pieces; short ones are remembered."""
        if len(self.seen) + sum(len(p) <= self.SHORT for p in pieces) > self.limit:
            self.seen.clear()
        out: dict[str, bytes] = {}
        lines = [p for p in pieces if p[:1] == _IS_LINE]
        out.update(zip(lines, self._learn([p[1:] for p in lines], "\n"), strict=True))
        out.update((p, self.whole(p[1:]).tobytes()) for p in pieces if p[:1] == _IS_STOP)
        words = [p for p in pieces if p[:1] not in (_IS_LINE, _IS_STOP)]
        out.update(zip(words, self._learn(words, " "), strict=True))
        self.seen.update({p: ids for p, ids in out.items() if len(p) <= self.SHORT})
        return out

    def encode(self, texts: pa.Array, chars: int = 2_500_000) -> Iterator[np.ndarray]:
        """Ids of each text (null: none), in groups of some `chars` bytes."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
            yield from self._encode(texts.slice(at, end - at))
            at = end

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Pieces are told apart by Arrow; what a group needs is learnt before it is put together."""
        if not self.by_piece:
            return [np.array(x.ids, "<u4") for x in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        alone = np.zeros(len(texts), bool)
        for t in (*self.added, _IS_STOP, _IS_LINE):
            alone |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring_regex(texts, _STOP, f"\\1 {_IS_STOP}\\2\\3"), "\n", f" {_IS_LINE}")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        index, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        wide = np.int32 if len(marked) and pc.sum(pc.binary_length(marked)).as_py() < 2**31 else np.int64
        del marked, lists, coded
        heads = bounds[:-1]
        got = list(map(self.seen.get, pieces))
        if None in got:
            # White space that isn't one space or newline between words touches one of these; none is remembered.
            missing = [i for i, g in enumerate(got) if g is None]
            odd = {i for i in missing if not (p := pieces[i]) or p[-1].isspace() or p[0].isspace() or p[0] == _IS_LINE and (len(p) == 1 or p[1].isspace())}
            if odd:
                touched = np.zeros(len(pieces), bool)
                touched[list(odd)] = True
                alone |= np.logical_or.reduceat(touched[index], heads)
            fresh = self.learn([pieces[i] for i in missing if i not in odd])
            for i in missing:
                got[i] = b"" if i in odd else fresh[pieces[i]]
        pool, size = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int32, len(got)) // 4
        del got
        first = np.cumsum(size, dtype=wide) - size
        # Heads stand without a space before them, so they are encoded by themselves.
        sizes = size[index]
        sizes[heads] = 0
        ends = np.cumsum(sizes, dtype=wide)
        place = np.repeat(first[index] - (ends - sizes), sizes)
        place += np.arange(ends[-1], dtype=wide)
        flat = pool[place]
        del place
        ends = np.concatenate(([0], ends))[bounds]
        opening = [texts[i].as_py() if a else pieces[h] for i, (h, a) in enumerate(zip(index[heads].tolist(), alone.tolist(), strict=True))]
        out = []
        for i, head in enumerate(self.tok.encode_batch_fast(opening, add_special_tokens=False)):
            ids = np.array(head.ids, "<u4")
            out.append(ids if alone[i] else np.concatenate((ids, flat[ends[i] : ends[i + 1]])))
        return out


def encoder(path: str) -> PieceEncoder:
    """The worker process's encoder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    return worker_cache(f"encoder {path}", lambda: PieceEncoder(path))


# --------------------------------------------------------------- the writer


def _store(path: str):
    """The file system of a URI, and the folder of the shards in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{path}/data")


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as a URI; one without a scheme is in Hadoop's default file system, as for Spark's own readers."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id",
              text_col: str = "text", shard_ids: int = 4 << 20, percentile: float = 0.95) -> DataFrame:
    """Encode `docs` and write shards under `path` in ascending document order; returns the manifest.

    Null texts are empty: the end id alone. Null ids come first; rows of one id
    are ordered by text hash and text and stay separate documents. An empty
    table writes no shard. Other columns, whatever their names, are not read. A task keeps at
    most `shard_ids` ids and one document in memory. File names are unique to
    the attempt, and only shards that the manifest lists count, so lost
    executors leave no wrong shard behind. Texts are brought in order, not
    ids: compressed, either takes as many bytes.
    """
    path = qualified(docs.sparkSession, path)

    def write(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.pfr"
            parts = shard_parts(names, held, percentile)
            with store.open_output_stream(f"{root}/{name}") as out:
                for data in parts:
                    out.write(data)
            row = {"file": name, "part": part, "seq": seq, "n_docs": len(names), "n_values": size, "bytes": sum(map(len, parts))}
            del parts, data
            release()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_values", pa.int64()), ("bytes", pa.int64())]))

        end = np.array([end_id], "<u4")
        gc.disable()  # many small objects live here, in no cycles
        try:
            for batch in arrived:
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    ids = np.concatenate((ids, end))
                    names.append(doc)
                    held.append(ids)
                    size += len(ids)
                    if size >= shard_ids:
                        yield flush()
                        names, held, size, seq = [], [], 0, seq + 1
            if held:
                yield flush()
        finally:
            gc.enable()
            names, held = [], []
            tidy()

    tied = F.xxhash64("text")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), tied)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tied, "text")
    )
    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest", 4096, 5 << 19)


# --------------------------------------------------------------- the reader


def read_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: id, start among all ids, number of ids, their crc32.

    Workers open the shards in the store that they were written to, so the
    bytes don't pass through the JVM, whose memory grew by them; starts are the sums of
    the manifest's counts before each shard plus the place within it. A shard
    of the manifest that isn't there in full raises an error; others, which
    lost attempts have left, are not read.
    """
    path = qualified(spark, path)

    def decode(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)
        store, root = _store(path)
        for batch in arrived:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as data:
                    shard = Shard(data.read())
                flat = memoryview(shard.values().astype("<u4", copy=False).view("u1"))
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["file", "pos", "doc_id", "local_start", "n_tokens", "ids_crc32"])
        tidy()

    # A row for each shard, some megabytes of ids: the window's one task and the broadcast hold a millionth of the ids' bytes.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_values").over(order), F.lit(0)).alias("base"))
    n_shards = manifest.count()
    if n_shards:
        files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pfr").load(f"{path}/data")
        files = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length")
        whole = manifest.join(files, "file", "left").agg(F.count_if(F.col("length").eqNullSafe(F.col("bytes"))).alias("whole")).first()["whole"]
        if whole != n_shards:
            raise ValueError(f"{n_shards - whole} of {n_shards} shards of the manifest are not in {path} in full")
    # As many tasks as shards; written, so that a worker gets one shard at a time, whatever the session's batches.
    names = manifest.select("file").repartition(max(n_shards, 1), "file")
    found = materialize(names.mapInArrow(decode, DECODED), "decoded", 1)
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_roundtrip(docs: DataFrame, tokenizer: str | None = None, *, end_id: int = 2) -> DataFrame:
    """Write every document's ids, then read the files back: a row for each of `docs`.

    Null texts, null and repeated ids and empty tables are as in `write_ids`;
    columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "ids")
    manifest = write_ids(docs, path, tokenizer or default_tokenizer(), end_id=end_id)
    return read_ids(spark, path, manifest)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_roundtrip(table(spark, sf_dir, "documents"))
