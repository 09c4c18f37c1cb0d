"""JSON out of model replies: fenced parts, brace scan, exact parsing, validity."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from dialoom.functions.folds import emitted, let
from dialoom.functions.text import strip

#: Characters of a reply that one substring is counted over.
STRETCH = 256

PAIRS = ArrayType(StructType([StructField("question", StringType()), StructField("answer", StringType())]))


def fenced(reply: Column) -> Column:
    """Contents of ```json fences, or the whole reply if it has none."""
    found = F.regexp_extract_all(reply, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(reply))


def brace_spans(text: Column) -> Column:
    """Array of (start, end) of the top-level brace groups, from 0: a scan over the braces of one row."""
    marks = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(i.alias("at"), c.alias("c"))), lambda m: m["c"].isin("{", "}"))
    opens = lambda s, m: m["c"] == "{"
    ends = lambda s, m: ~opens(s, m) & (s["depth"] == 1) & s["start"].isNotNull()

    def step(s: Column, m: Column) -> Column:
        start = F.when(opens(s, m) & (s["depth"] == 0), m["at"]).when(~ends(s, m), s["start"])
        return F.struct(F.when(opens(s, m), s["depth"] + 1).otherwise(s["depth"] - 1).alias("depth"), start.alias("start"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("start"))
    group = lambda s, m: F.struct(s["start"].alias("start"), m["at"].alias("end"))
    return emitted(marks, zero, step, ends, group, "struct<start:int,end:int>")


def brace_objects(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Rows (keys..., pos, object) of the top-level brace groups of `content`, without Python and without a shuffle.

    Depth counts braces wherever they stand, in strings too. A stray closing
    brace lowers it below zero, so the next opening brace starts no group.
    """
    def objects(text: Column) -> Column:
        # A substring is counted from the text's start: it is taken from a stretch of STRETCH characters instead.
        stretches = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / STRETCH).cast("int")), lambda k: F.substring(text, k * STRETCH + 1, F.lit(STRETCH)))

        def cut(ps: Column) -> Column:
            def group(s: Column) -> Column:
                near = F.array_join(F.transform(F.sequence(F.floor(s["start"] / STRETCH).cast("int"), F.floor(s["end"] / STRETCH).cast("int")), lambda j: F.get(ps, j)), "")
                return F.struct((s["start"] + 1).cast("long").alias("pos"), F.substring(near, s["start"] % STRETCH + 1, s["end"] - s["start"] + 1).alias("object"))

            return F.transform(brace_spans(text), group)

        return let(stretches, cut)

    return df.select(*keys, F.inline(objects(F.col(content))))


def scan_objects(text: str) -> Iterator[str]:
    """The brace groups of one text, as `brace_objects` finds them."""
    depth, start = 0, None
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start is not None:
                yield text[start : i + 1]
                start = None


def parse(content: str) -> list[dict]:
    """Objects of one reply part: a valid document's, or else those of its brace groups that are valid."""
    content = content.strip()
    if not content:
        return []
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        found = []
        for group in scan_objects(content):
            try:
                item = json.loads(group)
            except (ValueError, RecursionError):
                continue
            if isinstance(item, dict):
                found.append(item)
        return found
    items = value if isinstance(value, list) else [value]
    return [x for x in items if isinstance(x, dict)]


_LONE = re.compile("[\ud800-\udfff]")


def encodable(text: str) -> str:
    """Halves of surrogate pairs, which no encoding can hold, as the replacement character."""
    return _LONE.sub("\ufffd", text)


def as_question(value) -> str:
    """Strings as they are, other values as Python writes them."""
    return str(value)


def as_text(value) -> str:
    """Strings as they are, other values as JSON."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def valid(item: dict) -> bool:
    """Both fields there, neither empty nor false, with more than white space in them."""
    both = [item.get("question"), item.get("answer")]
    return all(both) and all(str(x).strip() for x in both)


_PAIRS_ARROW = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string())]))
#: Replies that a worker holds as Python objects at a time.
_AT_ONCE = 256


# Not deterministic to the optimizer, which else parses anew for each filter on what was found.
@F.arrow_udf(PAIRS)
def _parsed_pairs(parts: pa.Array) -> pa.Array:
    def one(row) -> list[dict] | None:
        if row is None:
            return None
        return [{"question": encodable(as_question(x["question"])), "answer": encodable(as_text(x["answer"]))} for part in row if part is not None for x in parse(part) if valid(x)]

    pieces = [pa.array([one(row) for row in parts.slice(at, _AT_ONCE).to_pylist()], _PAIRS_ARROW) for at in range(0, len(parts), _AT_ONCE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], _PAIRS_ARROW)


parsed_pairs = _parsed_pairs.asNondeterministic()
parsed_pairs.__doc__ = "Valid pairs of an array of reply parts, in order. A null array gives null."


def pairs_of(reply: Column) -> Column:
    """Valid pairs of a reply; null for no reply. Strict replies don't go through Python: there their place is null."""
    strict = strict_json(reply)
    return F.when(strict, strict_pairs(reply)).when(reply.isNotNull(), parsed_pairs(F.when(~strict, fenced(reply))))


#: Marks that stand for a question, an answer and a pair; JSON allows them nowhere.
_Q, _A, _PAIR = "\x01", "\x02", "\x03"
#: Longer replies are left to Python: parsers of this kind bound the length of a string.
STRICT_CHARS = 10_000_000


def strict_json(content: Column) -> Column:
    """Whether content is, as a whole, a JSON object of just a question and an answer, both strings, or an array of such.

    Told without parsing: escapes, then strings, then pairs are replaced by
    one mark each; what is left must be a bare list of pairs. False for null,
    and for some valid content (other fields, escaped surrogates).
    """
    text = strip(content)
    bare = F.regexp_replace(text, r'\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})', "x")
    # Without escapes, each quote opens or closes a string, and a backslash left over is a bad escape.
    field = lambda name: f'"{name}"[ \\t\\n\\r]*+:[ \\t\\n\\r]*+"[^"\\\\\\x00-\\x1f]*+"'
    marked = F.regexp_replace(F.regexp_replace(bare, field("question"), _Q), field("answer"), _A)
    pairs = F.regexp_replace(F.regexp_replace(marked, r"[ \t\n\r]+", ""), rf"\{{(?:{_Q},{_A}|{_A},{_Q})\}}", _PAIR)
    # Possessive, so that long lists are matched in a loop.
    listed = pairs.rlike(rf"\A(?:{_PAIR}|\[\]|\[{_PAIR}(?:,{_PAIR})*+\])\z")
    # A fence within a string would be taken for the reply's own.
    plain = ~text.rlike(f"[{_Q}{_A}{_PAIR}]|```json") & (F.char_length(text) <= STRICT_CHARS)
    return F.coalesce(plain & listed, F.lit(False))


def strict_pairs(content: Column) -> Column:
    """Valid pairs of content known to be a JSON array or object with string fields, without Python."""
    body = strip(content)
    whole = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    items = F.from_json(whole, PAIRS)
    return F.filter(items, lambda x: x["question"].isNotNull() & x["answer"].isNotNull() & (strip(x["question"]) != "") & (strip(x["answer"]) != ""))
