"""Text operators as column expressions: no Python worker is involved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import constants as C


def strip(text: Column) -> Column:
    """Without white space at both ends, in Python's sense of it."""
    return F.regexp_replace(text, rf"\A{C.WS}+|{C.WS}+\z", "")


def flatten_lines(text: Column) -> Column:
    """A layout block as one stripped line."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty pieces between double newlines; none for null."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip)
    return F.filter(pieces, lambda p: p != "")


def normalize_markers(text: Column) -> Column:
    """Full-width colons after speaker markers; runs of blank lines become one. Null is empty."""
    names = "|".join(C.NORMALISED_MARKERS)
    colons = F.regexp_replace(text, f"({names}){C.COLON}", f"$1{C.FULL_COLON}")
    return F.coalesce(F.regexp_replace(colons, rf"\n{C.WS}*\n{C.WS}*\n", "\n\n"), F.lit(""))


def quoted(literal: str) -> str:
    """`literal` as a Java expression that matches just it."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def clean_question(question: Column, prefixes: Sequence[str] | None = None) -> Column:
    """A question without its speaker.

    A known prefix goes first. Only if that, stripping included, changes
    nothing, any short name before a colon goes. Null is empty; an empty list
    of prefixes means the default ones.
    """
    names = "|".join(quoted(p) for p in prefixes or C.KNOWN_PREFIXES)
    known = strip(F.regexp_replace(question, rf"\A(?:{names}){C.COLON}{C.WS}*", ""))
    name = f"[{C.NAME_CHARS}{C.SPACES}]{{1,{C.NAME_LENGTH}}}"
    other = strip(F.regexp_replace(question, rf"\A{name}{C.COLON}{C.WS}*", ""))
    return F.coalesce(F.when(known != question, known).otherwise(other), F.lit(""))


def _any(words: Sequence[str], colon: bool) -> str:
    return f"(?:{'|'.join(words)}){C.COLON if colon else ''}"


def asks_directly(text: Column) -> Column:
    return F.coalesce(text.rlike(_any(C.DIRECT_MARKERS, True)), F.lit(False))


def asks_indirectly(text: Column) -> Column:
    return F.coalesce(text.rlike(f"{_any(C.CITED_MARKERS, True)}|{_any(C.CITED_PHRASES, False)}"), F.lit(False))


def answers(text: Column) -> Column:
    return F.coalesce(text.rlike(_any(C.ANSWER_MARKERS, True)), F.lit(False))


def has_qa(text: Column) -> Column:
    """Whether a block holds an answer marker and some form of question, anywhere in it."""
    return answers(text) & (asks_directly(text) | asks_indirectly(text))


def chinese_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(C.CHINESE)).cast("long")


def good_text(text: Column) -> Column:
    """Long enough, and Chinese in a tenth of its characters or more; null is not."""
    long = F.char_length(strip(text)) >= C.MIN_QUALITY_LENGTH
    return F.coalesce(long & (chinese_count(text) >= F.char_length(text) * F.lit(C.MIN_CHINESE_SHARE)), F.lit(False))
