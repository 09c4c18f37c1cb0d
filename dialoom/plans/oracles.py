"""DuckDB statements with the rows of the catalog's queries."""

from __future__ import annotations

from dialoom.plans.prompt import TEMPLATE


class C:
    """Fixed values, written out here anew: a slip in the library's own shows as a difference."""

    COLON = "[：:]"
    FULL_COLON = "："
    NORMALISED_MARKERS = ("网友", "问", "段永平", "段", "大道")
    DIRECT_MARKERS = ("网友", "问", "问题", "提问", "主持人", "观众", "Q")
    CITED_MARKERS = ("文章引用", "引用")
    CITED_PHRASES = ("有人说", "有人认为", "有观点认为", "据说", "听说")
    ANSWER_MARKERS = ("段永平", "段", "大道")
    KNOWN_PREFIXES = ("网友", "记者", "问", "提问者", "主持人", "文章引用", "Q", "观众", "评论", "主持", "用户")
    NAME_CHARS = "一-龥A-Za-z0-9（）【】「」《》\"、,，.。·"
    NAME_LENGTH = 20
    CHINESE = "[一-龥]"


_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS = f"[{_SPACES}]"
_BREAK = "chr(10) || chr(10)"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _clean(q: str, prefixes) -> str:
    known = _strip(rf"regexp_replace({q}, '\A(?:{'|'.join(prefixes)}){C.COLON}{_WS}*', '')")
    other = _strip(rf"regexp_replace({q}, '\A[{C.NAME_CHARS}{_SPACES}]{{1,{C.NAME_LENGTH}}}{C.COLON}{_WS}*', '')")
    return f"CASE WHEN {q} IS NULL THEN '' WHEN {known} <> {q} THEN {known} ELSE {other} END"


def _normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '({'|'.join(C.NORMALISED_MARKERS)}){C.COLON}', '\1{C.FULL_COLON}', 'g'), '\n{_WS}*\n{_WS}*\n', {_BREAK}, 'g')"


def _any(words, colon: bool) -> str:
    return f"(?:{'|'.join(words)}){C.COLON if colon else ''}"


_DIRECT, _ANSWER = _any(C.DIRECT_MARKERS, True), _any(C.ANSWER_MARKERS, True)
_INDIRECT = f"{_any(C.CITED_MARKERS, True)}|{_any(C.CITED_PHRASES, False)}"


def _has_qa(x: str) -> str:
    return f"(regexp_matches({x}, '{_ANSWER}') AND regexp_matches({x}, '{_DIRECT}|{_INDIRECT}'))"


_T1 = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS blk_no FROM documents WHERE text IS NOT NULL),
t1 AS (SELECT doc_id, blk_no, {_strip("line")} AS text FROM raw)"""
_T2 = """t2 AS (SELECT conv_id AS doc_id, turn, CASE role WHEN 'user' THEN '网友' WHEN 'assistant' THEN '段永平' WHEN 'system' THEN '主持人' ELSE '其他' END
              || CASE WHEN conv_id % 2 = 0 THEN '：' ELSE ':' END || replace(coalesce(text, ''), chr(10), ' ') AS para FROM conversations)"""
_T3 = f"""turns AS (SELECT conv_id AS doc_id, turn AS block_idx, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
adj AS (SELECT doc_id, block_idx, '网友：' || text AS question, t2 AS answer, '网友：' || text || {_BREAK} || '段永平：' || t2 AS block FROM turns WHERE role = 'user' AND r2 = 'assistant'),
js AS (SELECT *, CAST(to_json({{'question': question, 'answer': answer}}) AS VARCHAR) AS pair FROM adj),
t3 AS (SELECT *, CASE doc_id % 8 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[' || pair || ']' || chr(10) || '```' || chr(10) || 'end' WHEN 1 THEN '[' || pair || ']' WHEN 2 THEN pair
         WHEN 3 THEN pair || chr(10) || pair WHEN 4 THEN 'First ' || pair || ' stray }} then ' || pair WHEN 5 THEN '[{{"question": "cut off' || question WHEN 6 THEN NULL
         ELSE '[' || CAST(to_json({{'question': question, 'answer': '  '}}) AS VARCHAR) || ', 7, {{"question": "only"}}]' END AS response FROM js)"""


def _merge(source: str, max_size: int) -> str:
    """Blocks b(doc_id, seg_no, block) of rows (doc_id, o, text)."""
    return f"""p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k, text, length(text) AS n FROM ({source})),
g AS (SELECT doc_id, k, text, n AS cur, 0 AS seg FROM p WHERE k = 1
      UNION ALL
      SELECT p.doc_id, p.k, p.text, CASE WHEN g.cur + p.n > {max_size} THEN p.n ELSE g.cur + p.n END, CASE WHEN g.cur + p.n > {max_size} THEN g.seg + 1 ELSE g.seg END
      FROM g JOIN p ON p.doc_id = g.doc_id AND p.k = g.k + 1),
b AS (SELECT doc_id, CAST(seg AS BIGINT) AS seg_no, string_agg(text, {_BREAK} ORDER BY k) AS block FROM g GROUP BY doc_id, seg)"""


_OF_T1 = "SELECT doc_id, blk_no AS o, text FROM t1 WHERE text <> ''"
_OF_T2 = "SELECT doc_id, turn AS o, para AS text FROM t2"
_B1 = f"WITH RECURSIVE {_T1}, {_merge(_OF_T1, 1500)}"
_B2 = f"WITH RECURSIVE {_T2}, {_merge(_OF_T2, 600)}, i AS (SELECT * FROM b WHERE length(block) >= 100)"


def _sampled(source: str, ratio: str) -> str:
    return f"""s AS (SELECT doc_id, seg_no, block, row_number() OVER w - 1 AS block_idx
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM ({source}))
WHERE r <= greatest(CAST(trunc(n * {ratio}::DOUBLE) AS BIGINT), 1) WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no))"""


_FILTERED = f"{_B2}, {_sampled('SELECT * FROM i WHERE ' + _has_qa('block'), '0.5')}"

#: Parts of replies, then objects with their place, then valid pairs.
_PAIRS = f"""{_T3},
f AS (SELECT doc_id, block_idx, response, regexp_extract_all(response, '(?s)```json\\s*(.*?)\\s*```', 1) AS fs FROM t3 WHERE response IS NOT NULL),
parts AS (SELECT doc_id, block_idx, unnest(CASE WHEN len(fs) > 0 THEN fs ELSE [response] END) AS part, generate_subscripts(CASE WHEN len(fs) > 0 THEN fs ELSE [response] END, 1) AS pn FROM f),
ch AS (SELECT doc_id, block_idx, pn, part, unnest(string_split(part, '')) AS c, generate_subscripts(string_split(part, ''), 1) AS j FROM parts WHERE NOT json_valid(part)),
dp AS (SELECT *, CAST(sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS d FROM ch WINDOW w AS (PARTITION BY doc_id, block_idx, pn ORDER BY j)),
op AS (SELECT *, CAST(max(CASE WHEN c = '{{' AND d = 1 THEN j END) OVER w AS BIGINT) AS start FROM dp WINDOW w AS (PARTITION BY doc_id, block_idx, pn ORDER BY j)),
scanned AS (SELECT doc_id, block_idx, pn, start AS i, substring(part, start, j - start + 1) AS obj FROM op WHERE c = '}}' AND d = 0 AND start IS NOT NULL),
whole AS (SELECT doc_id, block_idx, pn, unnest(xs) AS obj, generate_subscripts(xs, 1) AS i
          FROM (SELECT *, CASE WHEN json_type(part) = 'ARRAY' THEN json_extract(part, '$[*]') ELSE [CAST(part AS JSON)] END AS xs FROM parts WHERE json_valid(part))),
objs AS (SELECT doc_id, block_idx, pn, i, CAST(obj AS VARCHAR) AS obj FROM whole WHERE json_type(obj) = 'OBJECT'
         UNION ALL SELECT doc_id, block_idx, pn, i, obj FROM scanned WHERE json_valid(obj)),
qa AS (SELECT doc_id, block_idx, pn, i, json_extract_string(obj, '$.question') AS question, json_extract_string(obj, '$.answer') AS answer FROM objs),
pairs AS (SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY pn, i) - 1 AS pair_idx, question, answer FROM qa
          WHERE {_strip("question")} <> '' AND {_strip("answer")} <> '')"""
_RESULTS = f"""{_PAIRS},
rec AS (SELECT doc_id, block_idx, pair_idx, {_clean("question", C.KNOWN_PREFIXES)} AS question, answer, block AS source_text FROM pairs JOIN (SELECT doc_id, block_idx, block FROM t3) USING (doc_id, block_idx)),
n AS (SELECT doc_id, block_idx, count(*) AS n FROM pairs GROUP BY ALL),
res AS (SELECT doc_id, block_idx, block, response, coalesce(n, 0) AS qa_count, response IS NOT NULL AND n IS NOT NULL AS success,
               CASE WHEN response IS NULL THEN 'LLM call failed' WHEN n IS NULL THEN 'No Q&A pairs extracted' END AS error FROM t3 LEFT JOIN n USING (doc_id, block_idx))"""
_QUESTIONS = "SELECT conv_id, turn, ['网友：', '问：Q: ', '张三：', ' 网友: ', '投资者 甲:', ''][conv_id % 6 + 1] || text || ' ' AS q FROM conversations"


def _cleaned(prefixes) -> str:
    return f"SELECT conv_id, turn, {_clean('q', prefixes)} AS cleaned FROM ({_QUESTIONS})"


_REPLAY = f"""{_B2}, s AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS block_idx FROM i WHERE {_has_qa("block")}),
k AS (SELECT DISTINCT {_normal("block")} AS p FROM s WHERE (doc_id + block_idx) % 3 <> 0),
a AS (SELECT s.*, k.p IS NOT NULL AS known, substring(block, 1, 20) AS q0, substring(block, 21, 40) AS a0 FROM s LEFT JOIN k ON k.p = {_normal("block")})"""
_DOCS = "SELECT DISTINCT conv_id AS doc_id FROM conversations"

#: The chain with a reply for each prompt: its last line, and its digest.
_RULED = f"""{_B2}, s AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS block_idx, {_lit(TEMPLATE)} || {_BREAK} || {_normal("block")} AS p FROM i),
q AS (SELECT *, list_last(string_split(p, chr(10))) AS q0 FROM s)
SELECT doc_id, block_idx, 0::BIGINT AS pair_idx, {_clean("q0", C.KNOWN_PREFIXES)} AS question, sha256(p) AS answer, block AS source_text FROM q WHERE {_strip("q0")} <> ''"""

ORACLE_SQL: dict[str, str] = {
    "layout_paragraphs": f"WITH {_T1} SELECT doc_id, CAST(blk_no AS BIGINT) AS blk_no, text FROM t1 WHERE text <> ''",
    "document_text": f"WITH {_T1} SELECT doc_id, coalesce(string_agg(t1.text, {_BREAK} ORDER BY blk_no), '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT * FROM t1 WHERE text <> '') AS t1 USING (doc_id) GROUP BY doc_id",
    "layout_text": f"WITH {_T1} SELECT doc_id, coalesce(string_agg(text, {_BREAK} ORDER BY blk_no) FILTER (text <> ''), '') AS text FROM t1 GROUP BY doc_id",
    "paragraph_split": f"""WITH s AS (SELECT doc_id, ' ' || {_BREAK} || chr(12288) || replace(text, chr(10), {_BREAK} || ' ' || {_BREAK}) || chr(10) || ' ' || chr(10) || 'end' AS x FROM documents),
u AS (SELECT doc_id, unnest(string_split(x, {_BREAK})) AS p, generate_subscripts(string_split(x, {_BREAK}), 1) AS k FROM s),
c AS (SELECT doc_id, k, {_strip("p")} AS text FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS para_no, text FROM c WHERE text <> ''""",
    "jsonl_append": f"WITH {_RESULTS} SELECT doc_id, question, answer FROM rec",
    "file_size": "SELECT CAST(sum(length(CAST(conv_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM conversations",
    "config_layers": f"""WITH n AS (SELECT max(length(text)) AS most, count(DISTINCT conv_id) AS chats, count(*) FILTER (role = 'assistant') AS answers, count(*) AS turns FROM conversations)
SELECT unnest(['max_block_size', 'min_block_size', 'extract_ratio', 'enable_qa_filter', 'output_dir', 'log_level', 'known_prefixes']) AS name,
       unnest([CAST(most AS VARCHAR), '100', CAST((answers * 100 // turns) / 100 AS VARCHAR), 'True', 'chats-' || chats, 'INFO', {_lit(",".join(C.KNOWN_PREFIXES))}]) AS value FROM n""",
    "llm_pipeline": _RULED, "resumed_run": _RULED,
    "paged_files": r"""WITH d AS (SELECT doc_id % 10 AS file, text, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS page_no, count(*) OVER (PARTITION BY doc_id % 10) + 1 AS page_count FROM documents WHERE text IS NOT NULL)
SELECT file, page_no, text, page_count FROM (SELECT file, page_no, page_count, unnest(string_split(text, chr(10))) AS text FROM d) WHERE text <> ''""",
    "file_info": """SELECT doc_id % 10 AS file, count(*) + 1 AS page_count, CAST(sum(strlen(text) + 2) AS BIGINT) AS file_size, false AS is_encrypted, true AS is_pdf FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
    "document_info": f"WITH {_T1} SELECT doc_id, 1::BIGINT AS page_count, count(*) AS n_blocks, count(*) FILTER (text <> '') AS n_paragraphs, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM raw JOIN t1 USING (doc_id, blk_no) GROUP BY doc_id",
    "blocks_default": f"{_B1} SELECT * FROM b WHERE length(block) >= 100",
    "blocks_long": f"{_B1} SELECT * FROM b WHERE length(block) >= 100",
    "blocks_small": f"WITH RECURSIVE {_T1}, {_merge(_OF_T1, 300)} SELECT * FROM b WHERE length(block) >= 50",
    "blocks_interview": f"WITH RECURSIVE {_T2}, {_merge(_OF_T2, 2000)} SELECT * FROM b WHERE length(block) >= 50",
    "blocks_dropped": f"{_B1} SELECT * FROM b WHERE length(block) < 100",
    "normalize_markers": f"WITH {_T2} SELECT doc_id, turn, {_normal('x')} AS text FROM (SELECT *, para || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || chr(10) || '阶段:' || para AS x FROM t2)",
    "has_qa": f"{_B2} SELECT doc_id, seg_no, {_has_qa('block')} AS has_qa FROM i",
    "has_qa_parts": f"{_B2} SELECT doc_id, seg_no, regexp_matches(x, '{_DIRECT}') AS direct, regexp_matches(x, '{_INDIRECT}') AS indirect, regexp_matches(x, '{_ANSWER}') AS answer FROM (SELECT *, CASE WHEN seg_no % 3 = 0 THEN '听说' ELSE '' END || block AS x FROM i)",
    "sample_prefix": f"{_B2}, {_sampled('SELECT * FROM i', '0.5')} SELECT doc_id, seg_no, block, block_idx FROM s",
    "filter_then_sample": f"{_FILTERED} SELECT doc_id, seg_no, block, block_idx FROM s",
    "prompts": f"{_FILTERED} SELECT doc_id, block_idx, sha256(x) AS prompt_sha256, length(x) AS prompt_chars FROM (SELECT *, {_lit(TEMPLATE)} || {_BREAK} || {_normal('block')} AS x FROM s)",
    "fenced_json": f"WITH {_PAIRS} SELECT doc_id, block_idx, CAST(pn - 1 AS BIGINT) AS part_no, part FROM parts",
    "brace_objects": f"""WITH {_T3}, ch AS (SELECT doc_id, block_idx, response, unnest(string_split(response, '')) AS c, generate_subscripts(string_split(response, ''), 1) AS j FROM t3 WHERE response IS NOT NULL),
dp AS (SELECT *, CAST(sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, block_idx ORDER BY j) AS BIGINT) AS d FROM ch),
op AS (SELECT *, CAST(max(CASE WHEN c = '{{' AND d = 1 THEN j END) OVER (PARTITION BY doc_id, block_idx ORDER BY j) AS BIGINT) AS start FROM dp)
SELECT doc_id, block_idx, start AS pos, substring(response, start, j - start + 1) AS object FROM op WHERE c = '}}' AND d = 0 AND start IS NOT NULL""",
    "parsed_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "strict_pairs": f"""WITH {_PAIRS},
sure AS (SELECT doc_id, block_idx FROM whole GROUP BY ALL
         HAVING bool_and(json_type(obj) = 'OBJECT' AND list_sort(json_keys(obj)) = ['answer', 'question'] AND json_type(obj, '$.question') = 'VARCHAR' AND json_type(obj, '$.answer') = 'VARCHAR'))
SELECT pairs.* FROM pairs JOIN sure USING (doc_id, block_idx) JOIN f USING (doc_id, block_idx) WHERE len(fs) = 0""",
    "clean_known": _cleaned(C.KNOWN_PREFIXES),
    "clean_fallback": _cleaned(["nobody"]),
    "clean_custom": _cleaned(["张三", "投资者 甲"]),
    "block_results": f"WITH {_RESULTS} SELECT doc_id, block_idx, success, error, qa_count FROM res",
    "qa_records": f"WITH {_RESULTS} SELECT doc_id, block_idx, pair_idx, question, answer, source_text FROM rec",
    "pair_numbers": f"WITH {_RESULTS} SELECT doc_id, block_idx, pair_idx, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, pair_idx) AS pair_no FROM rec",
    "run_stats": f"""WITH {_RESULTS},
t AS (SELECT doc_id, count(*) AS total, count(*) FILTER (success) AS ok, CAST(sum(qa_count) AS BIGINT) AS pairs FROM res GROUP BY doc_id),
l AS (SELECT doc_id, avg(length(question)) AS aq, avg(length(answer)) AS aa, min(length(question)) AS nq, max(length(question)) AS xq, min(length(answer)) AS na, max(length(answer)) AS xa FROM rec GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total_blocks, coalesce(ok, 0) AS successful_blocks, coalesce(total - ok, 0) AS failed_blocks, round(coalesce(ok / total, 0)::DOUBLE, 6) AS success_rate,
       coalesce(pairs, 0) AS qa_pairs_extracted, round(CASE WHEN ok > 0 THEN pairs / ok ELSE 0 END::DOUBLE, 6) AS avg_qa_per_block, 0::BIGINT AS pdf_pages,
       round(aq, 6) AS avg_question_length, round(aa, 6) AS avg_answer_length, nq::DOUBLE AS min_question_length, xq::DOUBLE AS max_question_length, na::DOUBLE AS min_answer_length, xa::DOUBLE AS max_answer_length,
       coalesce(total, 0) > 0 AS success, CASE WHEN coalesce(total, 0) = 0 THEN 'No text blocks to process' END AS message
FROM ({_DOCS}) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "extraction_quality": f"""WITH {_RESULTS},
q AS (SELECT doc_id, count(*) AS n, avg(length(question)) AS aq, avg(length(answer)) AS aa, count(DISTINCT question) AS u FROM rec GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS total_pairs, round(coalesce(aq, 0.0), 6) AS avg_question_length, round(coalesce(aa, 0.0), 6) AS avg_answer_length, coalesce(n <> u, false) AS has_duplicates,
       round(((CASE WHEN aq > 5 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN aa > 10 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN n = u THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN n > 0 THEN 0.2::DOUBLE ELSE 0 END))::DOUBLE, 6) AS quality_score
FROM ({_DOCS}) LEFT JOIN q USING (doc_id)""",
    "text_quality": f"""WITH {_T2}, m AS (SELECT doc_id, turn, repeat('中文字', CAST(floor(length(para) / (30 * (turn % 3 + 1))) AS BIGINT)) || para AS x FROM t2),
c AS (SELECT *, len(regexp_extract_all(x, '{C.CHINESE}')) AS n FROM m)
SELECT doc_id, turn, CAST(n AS BIGINT) AS chinese, length({_strip("x")}) >= 10 AND n >= length(x) * 0.1::DOUBLE AS good FROM c""",
    "error_log": f"WITH {_RESULTS} SELECT doc_id, block_idx + 1 AS block_no, error, response, block FROM res WHERE NOT success",
    "success_log": f"WITH {_RESULTS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, pair_idx) AS pair_no, block_idx + 1 AS block_no, question, answer FROM rec",
    "replay_pipeline": f"""{_REPLAY}, ok AS (SELECT *, known AND {_strip("a0")} <> '' AS good FROM a)
SELECT doc_id, block_idx, good AS success, CASE WHEN NOT known THEN 'LLM call failed' WHEN NOT good THEN 'No Q&A pairs extracted' END AS error, CAST(good AS BIGINT) AS qa_count,
       CASE WHEN good THEN {_clean("('问：' || q0)", C.KNOWN_PREFIXES)} END AS question, CASE WHEN good THEN a0 END AS answer FROM ok""",
    "jsonl_roundtrip": f"WITH {_RESULTS} SELECT question, answer, source_text FROM rec",
    "jsonl_count": "SELECT count(*) AS n FROM conversations WHERE turn % 5 <> 0",
    "jsonl_observed": """SELECT count(*) AS lines, count(*) FILTER (s = 0) AS blank, count(*) FILTER (s = 1) AS bad, count(*) FILTER (s > 0) AS rows, count(*) FILTER (s > 1) AS valid, count(*) FILTER (s = 4) AS items
FROM (SELECT turn % 5 AS s FROM conversations)""",
    "jsonl_items": """WITH j AS (SELECT turn % 5 AS s, text, CAST(to_json({'question': text}) AS VARCHAR) AS o FROM conversations WHERE turn % 5 <> 0)
SELECT CASE s WHEN 1 THEN 'not json' WHEN 2 THEN '7' WHEN 3 THEN '[' || o || ']' ELSE o END AS value, s <> 1 AS valid, CASE WHEN s = 4 THEN text END AS question FROM j""",
    "page_text": "SELECT doc_id, 1::BIGINT AS page_no, replace(text, chr(10), '') AS page_text FROM documents WHERE text IS NOT NULL",
}

#: However results are split, merged and streamed, the figures are those of one run.
ORACLE_SQL |= {name: ORACLE_SQL[of] for name, of in (("merged_stats", "run_stats"), ("merged_quality", "extraction_quality"), ("stream_pair_numbers", "pair_numbers"))}
