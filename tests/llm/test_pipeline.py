import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from dialoom.llm import token_binary as tb
from dialoom.llm.decontaminate import brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen[-1], SF)
        seen.append(spark.createDataFrame(made.collect(), made.schema))
    return seen


def test_stages_return_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    ids = [{r.doc_id for r in s.collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 100


def test_no_benchmark_passage_is_left(spark, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x[4] for x in brute_force([r.text for r in stages[3].collect()], items))


def test_no_copies_are_left(stages):
    assert max(Counter(r.text for r in stages[2].collect()).values()) == 1


def test_tokens_are_those_of_the_mix(stages):
    enc = tb.PieceEncoder(tb.default_tokenizer())
    want = Counter()
    for r in stages[4].collect():
        ids = np.array([*enc.tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, matched string, toxicity string, row_key string, class string, key string, pass string, taken string"


def odd_docs(spark):
    """Null ids, texts and sources, empty and wordless texts, repeated rows, a text of a million words, columns of names that stages use."""
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(1_000_000))
    plain = " ".join(f"v{i}" for i in range(40))
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n ...", None, "a", 7), (4, plain, "en", "a", len(plain)), (4, plain, "en", "a", len(plain)), (None, plain, "en", "b", len(plain)), (None, None, None, None, None), (9, long, "en", "b", len(long)), (10, plain + " more", "de", "", len(plain) + 5)]
    return spark.createDataFrame([(*r, *"mtrckpn") for r in rows], ODD)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = odd_docs(spark)
    out = stage(spark, docs, SF)
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
    if name == "token_binary":
        rows = out.collect()
        assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 4, 4, None, None, 9, 10]) and sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1]
        assert max(r.n_tokens for r in rows) > 1_000_000
        return
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.n) for r in out.selectExpr("doc_id", "length(text) n").collect())
    whole = Counter((r.doc_id, r.n) for r in docs.selectExpr("doc_id", "length(text) n").collect())
    if name == "near_dedup":
        # Of the plain text's three rows, and of what is like it, one stays: that of the null id.
        assert got == Counter({k: 1 for k in whole if k[0] not in (4, 10)}) + Counter({k: 1 for k in whole if k[0] == 10 and got[k]})
    elif name == "mixing":
        assert set(got) <= set(whole) and got[9, docs.where("doc_id = 9").selectExpr("length(text)").first()[0]] >= 1
    else:
        assert got == whole
        assert {tuple(r) for r in out.select("matched", "toxicity", "row_key", "class", "key", "pass", "taken").distinct().collect()} == {tuple("mtrckpn")}
