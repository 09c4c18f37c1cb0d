import pytest
from pyspark.sql import functions as F

from dialoom.functions import text


def value(spark, fn, x, kind="string"):
    return spark.createDataFrame([(x,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "expected"), [
    ("网友: a\n段:b", "网友： a\n段：b"), ("提问:x", "提问：x"), ("a\n\n\nb", "a\n\nb"), ("a\n \n\t\n b", "a\n\n b"), (None, ""), ("", ""), ("别人: a", "别人: a"),
])
def test_normalize_markers(spark, given, expected):
    assert value(spark, text.normalize_markers, given) == expected


@pytest.mark.parametrize(("given", "expected"), [
    ("网友：什么是好公司？", "什么是好公司？"), ("问：x", "x"), ("Q：x", "x"), ("没有前缀", "没有前缀"), ("", ""), (None, ""), ("网友：问：x", "问：x"), (" 张三：hi", "张三：hi"),
    (" Q: z", "Q: z"), ("网友：", ""), ("张三：hi", "hi"), ("http://x", "//x"), ("it's: x", "it's: x"), ('"甲": x', "x"), ("　网友：x", "网友：x"),
])
def test_clean_question(spark, given, expected):
    assert value(spark, text.clean_question, given) == expected


def test_clean_question_with_other_prefixes(spark):
    assert value(spark, lambda c: text.clean_question(c, ["甲方", "a.b"]), "甲方：x") == "x"
    assert value(spark, lambda c: text.clean_question(c, ["a.b"]), "网友：x") == "x"
    assert value(spark, lambda c: text.clean_question(c, []), "网友：问：x") == "问：x"


@pytest.mark.parametrize(("given", "expected"), [
    ("网友：a\n段永平：b", True), ("问: a\n段:b", True), ("文章引用：a\n大道：b", True), ("有人说a\n段：b", True),
    ("plain", False), ("网友：a", False), ("段永平：a", False), ("网友：a\n方丈：b", False), ("", False), (None, False), ("提问者：a\n段：b", False), ("阶段：a 听说", True),
])
def test_has_qa(spark, given, expected):
    assert value(spark, text.has_qa, given) is expected


@pytest.mark.parametrize(("given", "expected"), [
    ("这是一段足够长的中文文本内容。", True), ("", False), ("   ", False), ("短", False), ("1234567890123", False), (None, False), ("中" + "a" * 9, True), ("中" + "a" * 10, False), ("龦" + "a" * 9, False),
])
def test_good_text(spark, given, expected):
    assert value(spark, text.good_text, given) is expected


def test_strip_knows_python_white_space(spark):
    spaces = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    assert value(spark, text.strip, f"{spaces}a b{spaces}") == "a b"
    assert value(spark, text.strip, "​a﻿") == "​a﻿"


def test_paragraphs(spark):
    assert value(spark, text.paragraphs, " a \n\nb\n \nc\n\n\n\n") == ["a", "b\n \nc"]
    assert value(spark, text.paragraphs, None) == []
