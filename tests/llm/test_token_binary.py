import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import token_binary as tb


def test_codec_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for high in (1, 2, 50_000, 2**32):
            values = rng.integers(0, high, n).astype(np.uint32)
            values[rng.random(n) < 0.01] = 2**32 - 1
            shard = tb.Shard(tb.encode_shard([7, None], [values[: n // 3], values[n // 3 :]]))
            assert shard.doc_ids == [7, None] and (shard.values() == values).all() and (shard.values(3, 1500) == values[3:1500]).all()


def test_outliers_go_to_the_exception_list():
    values = np.full(1024, 5, np.uint32)
    values[10] = 2**31
    assert len(tb.encode_values(values)[1]) < 64


@pytest.fixture(scope="module")
def encoder():
    return tb.PieceEncoder(tb.default_tokenizer())


def test_pieces_give_the_ids_of_whole_texts(encoder):
    pick = random.Random(3)
    parts = ["a", "Word", "longer-than-ten-letters", "é", " ", " ", " ", ".", ",", "\n", "\t", "  ", "1", "'s", "\xa0", "×", "!", "..", "<|endoftext|>", "\x01", "\n\n", "\n ", " \n", "中"]
    for _ in range(600):
        texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(5)]
        for text, ids in zip(texts, encoder.encode(pa.array(texts), chars=30), strict=True):
            assert ids.tolist() == encoder.tok.encode(text, add_special_tokens=False).ids, text


def test_round_trip_through_files(spark, encoder):
    rows = [(5, "five words in this text", "x"), (1, None, "x"), (3, "", "x"), (None, "no id", "x"), (4, "b", "x"), (4, "a", "x"), (4, "a", "x"), (2, "two " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(tb.ids_roundtrip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 4, 5]
    at = 0
    for r in got:
        choices = [encoder.tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in rows if d == r.doc_id]
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in choices]
        at += r.n_tokens
    assert tb.ids_roundtrip(docs.limit(0)).count() == 0


def test_small_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    manifest = tb.write_ids(docs, str(tmp_path), tb.default_tokenizer(), shard_ids=10)
    assert manifest.count() > 5 and sorted(r.doc_id for r in tb.read_ids(spark, str(tmp_path), manifest).collect()) == list(range(50))


def test_other_tokenizers_encode_whole_texts(encoder):
    import json

    spec = json.loads(encoder.tok.to_str())
    assert tb.piecewise(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert not tb.piecewise(spec | change)
    whole = tb.PieceEncoder(tb.default_tokenizer())
    whole.by_piece = False
    assert [x.tolist() for x in whole.encode(pa.array(["a b. c\n d", None]))] == [encoder.tok.encode("a b. c\n d").ids, []]


def test_missing_shard_is_an_error_and_options_stay(spark, tmp_path):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    manifest = tb.write_ids(docs, str(tmp_path), tb.default_tokenizer(), shard_ids=10)
    assert tb.read_ids(spark, str(tmp_path), manifest).count() == 50 and [spark.conf.get(k) for k in keys] == before
    next((tmp_path / "data").glob("*.pfr")).unlink()
    with pytest.raises(ValueError, match="1 of"):
        tb.read_ids(spark, str(tmp_path), manifest)


def test_shards_are_read_without_passing_through_the_jvm(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    manifest = tb.write_ids(docs, str(tmp_path), tb.default_tokenizer(), shard_ids=10)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")  # bytes: any shard that Spark reads itself raises an error
    try:
        assert sorted(r.doc_id for r in tb.read_ids(spark, str(tmp_path), manifest).collect()) == list(range(50))
    finally:
        spark.conf.set(key, before)
