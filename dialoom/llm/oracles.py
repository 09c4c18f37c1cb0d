"""DuckDB statements with the rows of this subpackage's queries, where SQL can say them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_BENCH_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i
             FROM (SELECT item, w, least(10, len(w)) AS k FROM it WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_BENCH_WORDS} AS w FROM documents),
dg AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM iw))),
m AS (SELECT rid, dg.k, i, item FROM dg JOIN iw ON dg.k = iw.k AND dg.g = iw.g),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

_ESCAPED = r"replace(replace(text, '\', '\b'), '<|', '\l')"

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length({_ESCAPED}) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: Fair queueing in one global order; the query does the same sums in two levels.
OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY source_size * 2 / weight, rank) AS place,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, min(CASE WHEN source_size * 2 / weight > level THEN place END) OVER () AS first_open FROM f),
t AS (SELECT source, source_size, rank,
             CASE WHEN place >= first_open THEN weight * max(CASE WHEN place = first_open THEN level END) OVER () ELSE source_size * 2.0::DOUBLE END AS target
      FROM o),
q AS (SELECT d.*, source_size, rank, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, CAST(pass * source_size + upto AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) p(pass) WHERE target > 0 AND size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, upto, key, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM i),
k AS (SELECT rid, sum(size) AS taken FROM c WHERE used <= (SELECT sum(size) * 1.5::DOUBLE FROM d) GROUP BY rid)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
u AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM u) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM d JOIN l USING (rid) LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 10 * n_symbols > n_words AS r3, 2 * n_dup_lines > n_lines AS r4 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (r1) AS r1, count(*) FILTER (r2) AS r2, count(*) FILTER (r3) AS r3, count(*) FILTER (r4) AS r4 FROM f GROUP BY source),
long AS (SELECT source, n, unnest([r1, r2, r3, r4]) AS x, unnest([0.9, 0.5, 0.5, 0.5]) AS lim, unnest([1, 2, 3, 4]) AS rule FROM h),
s AS (SELECT rule, sum(x) / sum(n) AS mean, var_pop(x / n) AS var FROM long GROUP BY rule),
k AS (SELECT rule, mean, CASE WHEN var > 0 THEN greatest(2.0, least(10000.0, mean * (1 - mean) / var - 1)) ELSE 10000.0 END AS k FROM s),
v AS (SELECT source, bool_or((x + mean * k) / (n + k) > lim) AS bad FROM long JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2 OR r3 OR r4 OR bad) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP9 = r"""
WITH p AS (SELECT page_id AS p, url, html, substr(md5(coalesce(html, '')), 1, 16) AS tag FROM pages),
c AS (
  SELECT p * 2 AS record_id, url, p * 10 AS ts, 'full' AS kind, sha256(html) AS body, CAST(p * 10 AS VARCHAR) AS date, 'max-age=60' AS cc,
         CASE WHEN p % 4 < 2 THEN '"' || tag || '"' END AS etag, CASE WHEN p % 4 >= 2 THEN 'day ' || p END AS lm FROM p
  UNION ALL
  SELECT p * 2 + 1, url || '#again', p * 10 + 5 + p % 7 * 1000, 'revisit', NULL, CAST(p * 10 + 5 + p % 7 * 1000 AS VARCHAR), 'max-age=120',
         CASE p % 4 WHEN 0 THEN 'W/"' || tag || '"' WHEN 1 THEN '"other"' END, CASE WHEN p % 4 = 2 THEN 'day ' || p END FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@|:(80|443)$', '', 'g'), '^www\.', '')
             || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                             lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&') AS q FROM u),
k AS (SELECT *, hp || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM v),
w AS (SELECT *, last_value(CASE WHEN kind = 'full' THEN {'id': record_id, 'etag': etag, 'lm': lm, 'body': body} END IGNORE NULLS)
             OVER (PARTITION BY key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM k),
o AS (SELECT *, CASE WHEN kind = 'full' THEN 'full' WHEN s IS NULL THEN 'missing'
                     WHEN etag IS NOT NULL AND s.etag IS NOT NULL THEN CASE WHEN ltrim(etag, 'W/') = s.etag THEN 'resolved' ELSE 'changed' END
                     WHEN lm IS NOT NULL AND s.lm IS NOT NULL THEN CASE WHEN lm = s.lm THEN 'resolved' ELSE 'changed' END
                     ELSE 'resolved' END AS outcome FROM w),
h AS (SELECT *, CASE WHEN outcome = 'resolved' THEN coalesce(etag, s.etag) ELSE etag END AS e, CASE WHEN outcome = 'resolved' THEN s.lm ELSE lm END AS l FROM o)
SELECT record_id, key AS canonical, ts, outcome, CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN s.id ELSE -1 END AS source_id,
       CASE outcome WHEN 'resolved' THEN s.body ELSE body END AS body_sha256,
       sha256('cache-control: ' || cc || CASE WHEN outcome IN ('missing', 'changed') THEN chr(10) || 'content-length: 0' ELSE '' END
              || CASE WHEN outcome IN ('full', 'resolved') THEN chr(10) || 'content-type: text/html' ELSE '' END || chr(10) || 'date: ' || date
              || coalesce(chr(10) || 'etag: ' || e, '') || coalesce(chr(10) || 'last-modified: ' || l, '')) AS headers_sha256
FROM h
"""


def _op11(k: int = 40, dim: int = 64, rounds: int = 5) -> str:
    """Rounds one after the other. Doubles are exact here: their integers stay far below 2^53."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min(d) AS distance, arg_min(c, d * {k} + c) AS c
  FROM (SELECT rid, c, list_dot_product(v, v) - 2 * list_dot_product(v, x) + list_dot_product(x, x) AS d FROM v CROSS JOIN c{r}) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT c, list(m ORDER BY j) AS x FROM (
      SELECT c, j, floor(sum(v[j]) / count(*)) AS m FROM v JOIN a{r} USING (rid), range(1, {dim + 1}) t(j) GROUP BY c, j) GROUP BY c) n ON o.c = n.c)""")
    text = ",\n".join(steps)
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) = {dim}),
v AS MATERIALIZED (SELECT rid, vec_id, list_transform(x, lambda y: floor(256 * y)) AS v FROM e
      WHERE len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS x FROM v ORDER BY sha256('2:' || vec_id), v LIMIT {k}),
{text}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(z.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} z ON a.c = z.c
"""


OP11 = _op11()

#: Each order is a row of five filters; a document leaves at the first one that it fails.
OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < d.doc_id, false)} AS x
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, x.A AS A, x.B AS B, x.C AS C, x.D AS D, x.E AS E, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
g AS (SELECT *, list_concat(CASE WHEN A THEN ['A'] ELSE [] END, CASE WHEN B THEN ['B'] ELSE [] END, CASE WHEN C THEN ['C'] ELSE [] END, CASE WHEN D THEN ['D'] ELSE [] END, CASE WHEN E THEN ['E'] ELSE [] END) AS fails FROM m),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, bad, fails, list_contains(fails, substr(filter_order, step, 1)) AS hit,
             len(list_filter(fails, lambda z: instr(filter_order, z) < step)) AS before FROM g, o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, sum(CASE WHEN NOT hit AND before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN hit AND before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND len(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN hit AND before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND before = 0 THEN bad ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

#: What the extractor must find in pages whose one `article` holds only headings and paragraphs, with no other references than these.
OP12 = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS b FROM pages),
t AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM t)
"""
