import random

from dialoom.llm.decontaminate import Matcher, brute_force, char_spans, decontaminate, match_items, merged


def direct(texts, items):
    m = Matcher(items)
    return [(n, sum(b - a for a, b in spans), len(found), bool(spans)) for n, spans, found in map(m.match, texts)]


def test_automaton_equals_brute_force():
    pick = random.Random(1)
    for _ in range(1500):
        items = [(str(i), " ".join(pick.choice("abc") for _ in range(pick.randint(0, 14)))) for i in range(pick.randint(0, 4))]
        texts = [" ".join(pick.choice("abcd") for _ in range(pick.randint(0, 60))) for _ in range(2)]
        assert direct(texts, items) == [(n, h, k, c) for n, h, k, _, c in brute_force(texts, items)]


def test_char_spans_fold_only_ascii():
    text = "É aB-cd é"
    assert [text[a:b] for a, b in char_spans(text, [(0, 1), (1, 3)])] == ["É", "aB-cd"]
    assert merged([(3, 4), (0, 2), (2, 3)]) == [(0, 4)]


ITEM = "one two three four five six seven eight nine ten eleven"


def frames(spark):
    docs = spark.createDataFrame(
        [(1, f"Lead {ITEM.upper()} tail of many other words that stay here in the text for ever and ever more", "a"), (2, ITEM, "a"), (3, None, None), (4, "", "b"), (5, "clean text", "b"), (5, "clean text", "b")],
        "doc_id long, text string, matched string")
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (None, None, 0), (2, "", 0), (3, "alpha beta", 0)], "item_id long, text string, n_words int")
    return docs, items


def test_spans_are_removed_and_covered_documents_dropped(spark):
    docs, items = frames(spark)
    out = decontaminate(docs, items)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert [d for d, _ in got] == [1, 3, 4, 5, 5]
    assert got[0][1].startswith("Lead  tail of many")


def test_many_automata_give_the_same_result(spark):
    docs, items = frames(spark)
    assert sorted(map(str, decontaminate(docs, items, shard_chars=30).collect())) == sorted(map(str, decontaminate(docs, items).collect()))
    items = items.unionByName(spark.createDataFrame([(9, "tail of many other words that stay here in the text", 0), (10, "six seven eight nine ten eleven tail of many other", 0)], items.schema))
    one = match_items(docs, items, name="m").select("doc_id", "m").collect()
    more = match_items(docs, items, name="m", shard_chars=60).select("doc_id", "m").collect()
    flat = lambda rows: sorted(str((r.doc_id, r.m.n_words, [(s.start, s.end) for s in r.m.spans], r.m["items"])) for r in rows)
    assert flat(one) == flat(more)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontaminate(docs.limit(0), items).count() == 0


def test_words_beside_a_cut_make_no_new_passage(spark):
    from dialoom.llm.decontaminate import decontaminate

    inner, outer = " ".join(f"i{k}" for k in range(10)), [f"o{k}" for k in range(10)]
    text = " ".join([*[f"x{k}" for k in range(60)], *outer[:5], inner, *outer[5:], "end"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, inner), (2, " ".join(outer))], "item_id long, text string")
    assert decontaminate(docs, items).first().text.split() == [*[f"x{k}" for k in range(60)], "end"]


def test_many_automata_cut_until_nothing_matches(spark):
    layers = [[f"{c}{k}" for k in range(10)] for c in "iop"]
    text = layers[0]
    for words in layers[1:]:
        text = [*words[:5], *text, *words[5:]]
    rest = [f"x{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join([*rest, *text, "end"])), (1, " ".join(rest)), (2, " ".join(layers[0])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(layers)], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate(docs, items, shard_chars=n).collect())) for n in (1_000, 20))
    assert one == many and len(many) == 3
    assert [r.text.split() for r in decontaminate(docs, items, shard_chars=20).where("text like '%end'").collect()] == [[*rest, "end"]]
    assert match_items(docs, items, shard_chars=20).dtypes == match_items(docs, items).dtypes
