"""What a model is asked for each block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.constants import ANSWER_MARKERS

TEMPLATE = f"""You read part of an interview transcript in Chinese and list every question with its answer.

A question may be asked directly by a speaker, quoted from an article, reported ("some say"), or be a topic that someone brings up.
Only text spoken by {ANSWER_MARKERS[0]} (also written {ANSWER_MARKERS[1]} or {ANSWER_MARKERS[2]}) is an answer. Leave out other speakers, headings and tables of contents.
Give questions and answers whole, in the transcript's words.

Reply with a JSON array of objects {{"question": "...", "answer": "..."}} and nothing else; reply [] if there is none.

Transcript:"""


def prompt(text: Column) -> Column:
    return F.concat(F.lit(TEMPLATE), F.lit("\n\n"), text)
