import random
import re

import pytest

from dialoom.llm import pii
from dialoom.llm.pii import find_pii, mask_pii, spans_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base contract by the expressions as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(m)[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_plain_expressions():
    pick = random.Random(5)
    for _ in range(4000):
        text = "".join(pick.choice("ab.@@1234567890..+-- (é") for _ in range(pick.randint(0, 60)))
        assert [(s.kind, s.start, s.end) for s in spans_of(text) if s.kind in pii.BASE] == plain(text), text


@pytest.mark.parametrize(("text", "kinds"), [
    ("", []), (None, []), ("x a@b.c y", ["email"]), ("é 4111 1111 1111 1111", ["card"]), ("4111 1111 1111 1112", []),
    ("300.1.1.1", []), ("GB82 WEST 1234 5698 7654 32", ["iban"]), ("GB82 WEST 1234 5698 7654 33", []),
    ("123-45-6789", []), ("social security 123-45-6789", ["ssn"]), ("call +1 (988) 555-2485 now", ["phone"]),
])
def test_cases(text, kinds):
    assert [s.kind for s in spans_of(text)] == kinds


def test_hostile_texts_take_linear_time():
    for text in ("1" * 200_000, "a." * 100_000, "a@" * 100_000, "+1" * 100_000, "1.2." * 50_000, "A" * 200_000):
        spans_of(text)


def test_frame(spark):
    rows = [(1, "mail a@b.c", "x"), (1, "mail a@b.c", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, masked string")
    assert sorted(len(r.pii) for r in find_pii(docs).collect()) == [0, 0, 1, 1]
    assert sorted(str(r.text) for r in mask_pii(docs).collect()) == ["", "None", "mail [email]", "mail [email]"]
    assert mask_pii(docs).columns == docs.columns
    assert find_pii(docs.limit(0)).count() == 0
