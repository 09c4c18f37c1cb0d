import itertools
import random
import re
from collections import Counter

from dialoom.llm.audit import COUNTS, FILTERS, audit, failures, incidence

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """The audit by applying the filters, one order after the other."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        said = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((lang or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations(FILTERS):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(lost), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[part, f] += len(lost)
                gone += lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}


def random_docs(seed, n=250):
    pick = random.Random(seed)
    docs = []
    for i in range(n):
        words = [pick.choice([f"w{pick.randint(0, 400)}", "A", "BIG", "é", "x" * pick.randint(1, 9)]) for _ in range(pick.choice([0, 5, 99, 100, 130]))]
        text = pick.choice([None, "", pick.choice([" ", "\t", "\x0b", "\xa0"]).join(words), " ".join(words) + pick.choice(["", "#", "|"]), " ".join(f"w{k}" for k in range(pick.choice([99, 100, 120])))])
        docs.append((pick.choice([i, i, i, None, i // 2]), text, pick.choice([None, "", "en", "de"])))
    labels = [(pick.choice([None, pick.randint(0, n)]), pick.choice([None, 0, 1, 2]), pick.choice([None, 0, 1])) for _ in range(n)]
    return docs, labels


def test_equals_applying_the_filters(spark):
    for seed in (1, 2):
        docs, labels = random_docs(seed)
        assert audited(spark, docs, labels) == plain(docs, labels)


def test_copies_ids_and_repeated_rows(spark):
    good = " ".join(f"w{k}" for k in range(120))
    docs = [(5, good, "en"), (5, good, "en"), (3, good, "de"), (None, good, "en"), (9, good, None), (None, None, "en")]
    rows = {(r.part, r["mask"]): (r.n, r.good, r.toxic) for r in failures(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, 1, 1), (5, 0, 0), (None, 1, 1)], LABELS)).collect()}
    # Id 3 has the text first; both rows of id 5 and the one of id 9 are copies, a null id is none.
    assert rows == {("en", 16): (2, 2, 2), ("de", 0): (1, 0, 0), ("en", 0): (1, 0, 0), ("", 16): (1, 0, 0), ("en", 1): (1, 0, 0)}


def test_matrices_account_for_every_mask():
    orders, by = incidence()
    assert len(orders) == 120 and all(m.shape == (32, 600) for m in by.values())
    for k in range(120):
        steps = slice(5 * k, 5 * k + 5)
        assert (by["removed"][1:, steps].sum(axis=1) == 1).all() and (by["kept"][:, 5 * k + 4] == [1, *[0] * 31]).all()
    # A mask's removals over all orders are shared evenly by the filters that it fails.
    first = by["shapley"][:, :5]
    assert all((first[m, f] == (120 // bin(m).count("1") if m >> f & 1 else 0)) for m in range(1, 32) for f in range(5))


def test_no_documents_hot_groups_long_texts_and_clashing_names(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(i, "same text", "en") for i in range(3000)] + [(7000, " ".join(f"w{k}" for k in range(300_000)), "en")]
    frame = spark.createDataFrame([(*d, "x", 1, 2, 3, True, 4) for d in docs], f"{DOCS}, digest string, id int, part int, n int, first boolean, mask int").repartition(8)
    rows = {r["mask"]: r.n for r in failures(frame, spark.createDataFrame([], LABELS)).collect()}
    assert rows == {1: 1, 17: 2999, 0: 1}
