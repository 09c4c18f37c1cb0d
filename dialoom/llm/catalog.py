"""Queries and DuckDB statements of this subpackage, by name."""

from __future__ import annotations

from dialoom.llm import oracles
from dialoom.llm.audit import op13_filter_audit
from dialoom.llm.chat import op1_chat_format
from dialoom.llm.decontaminate import op3_decontaminate
from dialoom.llm.kmeans import op11_kmeans
from dialoom.llm.lm import op7_lm_score
from dialoom.llm.mixing import op2_mixing
from dialoom.llm.near_dedup import op6_near_dedup
from dialoom.llm.pages import op12_html_extract
from dialoom.llm.pii import op5_pii
from dialoom.llm.quality import op8_quality
from dialoom.llm.token_binary import op4_token_binary
from dialoom.llm.toxicity import op10_toxicity
from dialoom.llm.warc import op9_warc_revisit

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_binary": op4_token_binary,
    "op5_pii": op5_pii,
    "op6_near_dedup": op6_near_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_toxicity": op10_toxicity,
    "op11_kmeans": op11_kmeans,
    "op12_html_extract": op12_html_extract,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op1_chat_format": oracles.OP1,
    "op2_mixing": oracles.OP2,
    "op3_decontaminate": oracles.OP3,
    "op8_quality": oracles.OP8,
    "op9_warc_revisit": oracles.OP9,
    "op11_kmeans": oracles.OP11,
    "op12_html_extract": oracles.OP12,
    "op13_filter_audit": oracles.OP13,
}
