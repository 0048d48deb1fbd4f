"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations

from quantfold.llm import license_scan

WORD = r"[^\x20\x09-\x0D]+"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '{WORD}')"

URL_FILTERS = r"""
WITH hosts AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[^:]+://[^/?#]+/([^/?#]+)', 1) AS step,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
single AS (SELECT DISTINCT host FROM hosts WHERE host <> ''),
num AS (SELECT host, CAST('0x' || md5('bad:' || host)[1:6] AS BIGINT) AS bad, CAST('0x' || md5('r:' || host)[1:6] AS BIGINT) AS r,
               CAST(DATE '2024-01-01' + CAST(CAST('0x' || md5('a:' || host)[1:6] AS BIGINT) % 366 AS INT) AS DATE) AS first,
               array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM single),
paths AS (SELECT DISTINCT host || '/' || step AS key FROM hosts WHERE host <> '' AND step <> ''),
log AS (
  SELECT 'hosts' AS list_name, 'block' AS verdict, host AS key, 'add' AS action, first AS effective FROM num WHERE bad % 3 = 0
  UNION ALL SELECT 'hosts', 'block', host, 'remove', CAST(first + 40 AS DATE) FROM num WHERE bad % 3 = 0 AND r % 2 = 0
  UNION ALL SELECT 'hosts', 'block', host, 'add', CAST(first + 100 AS DATE) FROM num WHERE bad % 3 = 0 AND r % 4 = 0
  UNION ALL SELECT DISTINCT 'domains', 'block', domain, 'add', CAST(DATE '2024-07-01' + CAST(CAST('0x' || md5('d:' || domain)[1:6] AS BIGINT) % 180 AS INT) AS DATE) FROM num
  UNION ALL SELECT 'paths', 'allow', key, 'add', CAST(DATE '2024-01-01' + CAST(CAST('0x' || md5('p:' || key)[1:6] AS BIGINT) % 366 AS INT) AS DATE)
            FROM paths WHERE CAST('0x' || md5('path:' || key)[1:6] AS BIGINT) % 4 = 0),
spans AS (
  SELECT * FROM (SELECT *, lead(effective) OVER (PARTITION BY list_name, verdict, key ORDER BY effective, action DESC) AS valid_to FROM log)
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > effective)),
captures AS (SELECT DISTINCT url, fetched, host, path FROM hosts WHERE url IS NOT NULL AND host <> ''),
steps AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM captures),
keyed AS (
  SELECT url, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))))) AS key
  FROM steps),
active AS (
  SELECT k.url, k.fetched, k.key, s.list_name, s.verdict FROM keyed k JOIN spans s ON k.key = s.key
  WHERE k.fetched >= s.effective AND (s.valid_to IS NULL OR k.fetched < s.valid_to)),
best AS (
  SELECT url, fetched, count(*) AS n_active, max(struct_pack(n := length(key), key := key, allow := verdict = 'allow')) AS best FROM active GROUP BY 1, 2),
decided AS (
  SELECT b.url, b.fetched, any_value(b.n_active) AS n_active, any_value(b.best) AS best, string_agg(DISTINCT a.list_name, ',' ORDER BY a.list_name) AS lists
  FROM best b JOIN active a ON a.url = b.url AND a.fetched = b.fetched AND a.key = b.best.key GROUP BY 1, 2)
SELECT h.page_id, h.url, h.fetched, h.host, coalesce(d.n_active, 0) AS n_active, d.best.key AS matched_key, coalesce(d.lists, '') AS lists,
       coalesce(d.best.allow, true) AS allowed
FROM hosts h LEFT JOIN decided d ON h.url = d.url AND h.fetched = d.fetched
"""

CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length('<turn><text></turn>' || chr(10)) + length(replace(replace(role, '\', '\s'), '<', '\l')) + length(replace(replace(text, '\', '\s'), '<', '\l')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

SOURCE_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         CAST(CAST('0x' || md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM per),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER o AS BIGINT), 0)) / (CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER o AS BIGINT), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, cap / w) AS water FROM levels WHERE cap / w > level),
goals AS (
  SELECT source, source_size, CASE WHEN cap / w > level THEN water * w ELSE CAST(cap AS DOUBLE) END AS target FROM levels LEFT JOIN water ON true),
expected AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN size > 0 THEN least(3.0::DOUBLE, g.target / g.source_size) ELSE 0 END AS e
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
split AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM expected),
need AS (SELECT source AS ns, max(target) - sum(whole * size)::BIGINT AS need FROM split GROUP BY source),
ranked AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS key, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER o AS up_to
  FROM split WINDOW o AS (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
taken AS (
  SELECT r.*, whole + CASE WHEN p > 0 AND need > 0 AND (up_to <= need OR (up_to - size < need AND up_to - need < need - (up_to - size))) THEN 1 ELSE 0 END AS copies
  FROM ranked r JOIN need n ON r.source IS NOT DISTINCT FROM n.ns)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM taken
"""

BIN = "CASE WHEN v < 64 THEN v WHEN v < 128 THEN v - v % 2 WHEN v < 256 THEN v - v % 4 WHEN v < 512 THEN v - v % 8 ELSE v - v % 16 END"

QUALITY_RULES = rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT *, list_transform(range(1, greatest(len(w) - 4, 0) + 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) AS win, row_number() OVER () AS r FROM split),
placed AS (SELECT r, unnest(win) AS win, generate_subscripts(win, 1) AS i FROM windows),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM placed) WHERE c > 1),
cover AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
base AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(cover.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) AS n_chars FROM windows LEFT JOIN cover USING (r)),
rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (n_chars - word_chars) * 1000 // greatest(n_chars, 1) AS space_pm,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbol_pm, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_pm FROM base),
long AS (
  SELECT lang, source, 'space_pm' AS measure, 30 AS slack, space_pm AS v FROM rated
  UNION ALL SELECT lang, source, 'symbol_pm', 20, symbol_pm FROM rated
  UNION ALL SELECT lang, source, 'dup_line_pm', 350, dup_line_pm FROM rated),
bins AS (SELECT lang, source, measure, slack, {BIN} AS bin FROM long),
levels AS (
  SELECT l AS level, CASE WHEN l >= 1 THEN lang END AS lang, CASE WHEN l >= 2 THEN source END AS source, measure, slack, bin FROM bins, (SELECT unnest([0, 1, 2]) AS l)),
sorted AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS k, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM levels),
quartiles AS (
  SELECT level, lang, source, measure, slack, n, min(bin) FILTER (4 * k >= n) AS q1, min(bin) FILTER (4 * k >= 3 * n) AS q3 FROM sorted GROUP BY ALL HAVING level = 0 OR n >= 200),
fences AS (
  SELECT level, lang, source, measure, CASE WHEN measure = 'space_pm' THEN greatest(q1 - 3 * (q3 - q1) - slack, 0) ELSE 0 END AS lo, q3 + 3 * (q3 - q1) + slack + CASE WHEN measure = 'space_pm' THEN 0 ELSE q3 // 4 END AS hi FROM quartiles),
by_lang AS (
  SELECT g.lang, g.source, a.measure, b.level IS NOT NULL AS has, CASE WHEN b.level IS NULL THEN a.lo ELSE greatest(b.lo, a.lo - (a.hi - a.lo)) END AS lo,
         CASE WHEN b.level IS NULL THEN a.hi ELSE least(b.hi, a.hi + (a.hi - a.lo)) END AS hi
  FROM (SELECT DISTINCT lang, source FROM rated) g CROSS JOIN (SELECT * FROM fences WHERE level = 0) a
  LEFT JOIN fences b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM g.lang AND b.measure = a.measure),
chosen AS (
  SELECT p.lang, p.source, p.measure, CASE WHEN c.level IS NOT NULL THEN 2 WHEN p.has THEN 1 ELSE 0 END AS level,
         CASE WHEN c.level IS NULL THEN p.lo ELSE greatest(c.lo, p.lo - (p.hi - p.lo)) END AS lo, CASE WHEN c.level IS NULL THEN p.hi ELSE least(c.hi, p.hi + (p.hi - p.lo)) END AS hi
  FROM by_lang p LEFT JOIN fences c ON c.level = 2 AND c.lang IS NOT DISTINCT FROM p.lang AND c.source IS NOT DISTINCT FROM p.source AND c.measure = p.measure),
wide AS (
  SELECT lang, source, max(level) AS sketch_level, max(lo) FILTER (measure = 'space_pm') AS space_pm_least, max(hi) FILTER (measure = 'space_pm') AS space_pm_limit,
         max(hi) FILTER (measure = 'symbol_pm') AS symbol_pm_limit, max(hi) FILTER (measure = 'dup_line_pm') AS dup_line_pm_limit FROM chosen GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND space_pm BETWEEN space_pm_least AND space_pm_limit AND symbol_pm <= symbol_pm_limit AND dup_line_pm <= dup_line_pm_limit AS kept,
       space_pm, symbol_pm, dup_line_pm, space_pm_least, space_pm_limit, symbol_pm_limit, dup_line_pm_limit, sketch_level
FROM rated JOIN wide ON rated.lang IS NOT DISTINCT FROM wide.lang AND rated.source IS NOT DISTINCT FROM wide.source
"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD_JOIN = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS s FROM split),
uniq AS (SELECT list_sort(s) AS s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tok AS (SELECT node, len(s) AS n, unnest(s) AS t FROM uniq),
inter AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS k FROM tok a JOIN tok b ON a.t = b.t AND a.node < b.node
          WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM inter WHERE 100 * k >= 90 * (na + nb - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node, node AS r FROM uniq UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.r = ways.a),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM sets d LEFT JOIN uniq u ON u.s = list_sort(d.s) LEFT JOIN comp ON comp.node = u.node
"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BENCHMARK_DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT l FROM win),
runs AS (
  SELECT r, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM docs, sizes WHERE len(w) >= l),
hit AS (SELECT r, i, runs.l, item_id FROM runs JOIN win ON runs.l = win.l AND runs.s = win.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang FROM counted GROUP BY ALL HAVING sum(n_docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.term, k.n_lang, coalesce(c.n, 0) AS n, v, total_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counted c USING (lang, source, term)),
scored AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(total + 5 * v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * CAST(n_lang + 5 AS HUGEINT)) // CAST(total_lang + 5 * v AS HUGEINT) AS q
  FROM grid),
groups AS (SELECT DISTINCT lang, source FROM docs),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM scored a JOIN scored b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM scored WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM starts),
firsts AS (SELECT win, min(doc_id) AS lo FROM windows GROUP BY win),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (win) WHERE lo < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations),
kinds AS (
  SELECT * EXCLUDE (bytes), xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS pos, lag(role[1:1]) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
options AS (
  SELECT conv_id, pos, role[1:1] AS ini, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, fault NOT IN ('blank', 'duplicate') AS stays, role || ':' || text || chr(10) AS line,
         text || chr(10) AS rest
  FROM judged),
togo AS (
  SELECT conv_id, n AS pos, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s1,
         {'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)} AS s2, {'c': 0, 'a': '', 't': ''} AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, pos - 1, least(b0, {'c': d2.c + 2, 'a': 'I' || d2.a, 't': 'user:' || chr(10) || d2.t}), least(b1, {'c': d2.c + 2, 'a': 'I' || d2.a, 't': 'user:' || chr(10) || d2.t}), d2,
         least(b3, {'c': d2.c + 2, 'a': 'I' || d2.a, 't': 'user:' || chr(10) || d2.t})
  FROM (
    SELECT *, least(b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 't': 'assistant:' || chr(10) || b3.t}) AS d2
    FROM (
      SELECT g.conv_id, g.pos,
        least({'c': s0.c + 3, 'a': 'D' || s0.a, 't': s0.t}, {'c': CASE WHEN stays THEN s2.c + 2 + cut ELSE 1000000000 END, 'a': 'R' || s2.a, 't': 'user:' || rest || s2.t},
              {'c': CASE WHEN stays AND ini = 'u' THEN s2.c + cut ELSE 1000000000 END, 'a': 'K' || s2.a, 't': line || s2.t}, {'c': CASE WHEN stays AND ini = 's' THEN s1.c + cut ELSE 1000000000 END, 'a': 'K' || s1.a, 't': line || s1.t}) AS b0,
        least({'c': s1.c + 3, 'a': 'D' || s1.a, 't': s1.t}, {'c': CASE WHEN stays THEN s2.c + 2 + cut ELSE 1000000000 END, 'a': 'R' || s2.a, 't': 'user:' || rest || s2.t},
              {'c': CASE WHEN stays AND ini = 'u' THEN s2.c + cut ELSE 1000000000 END, 'a': 'K' || s2.a, 't': line || s2.t}) AS b1,
        least({'c': s2.c + 3, 'a': 'D' || s2.a, 't': s2.t}, {'c': CASE WHEN stays THEN s3.c + 2 + cut ELSE 1000000000 END, 'a': 'R' || s3.a, 't': 'assistant:' || rest || s3.t},
              {'c': CASE WHEN stays AND ini = 'a' THEN s3.c + cut ELSE 1000000000 END, 'a': 'K' || s3.a, 't': line || s3.t}) AS b2,
        least({'c': s3.c + 3, 'a': 'D' || s3.a, 't': s3.t}, {'c': CASE WHEN stays THEN s2.c + 2 + cut ELSE 1000000000 END, 'a': 'R' || s2.a, 't': 'user:' || rest || s2.t},
              {'c': CASE WHEN stays AND ini = 'u' THEN s2.c + cut ELSE 1000000000 END, 'a': 'K' || s2.a, 't': line || s2.t}) AS b3
      FROM togo g JOIN options o ON g.conv_id = o.conv_id AND g.pos = o.pos))),
best AS (SELECT conv_id, s0 FROM togo WHERE pos = 0)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id)
"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_scans() -> str:
    known = ", ".join(f"({_quote(license_scan.normal_form(s))}, {_quote(name)})" for name, s in license_scan.SENTENCES)
    rules = sorted(license_scan.RULES)
    steps = "matched0 AS (SELECT *, written AS s FROM agg)"
    for rank, _, ids in rules:
        seq = _quote("".join(f"<{i}>" for i in ids))
        steps += f",\nmatched{rank} AS (SELECT * EXCLUDE (s), contains(s, {seq}) AS hit{rank}, replace(s, {seq}, '<#>') AS s FROM matched{rank - 1})"
    found = ", ".join(f"CASE WHEN hit{rank} THEN {_quote(name)} END" for rank, name, _ in rules)
    return rf"""
WITH known(norm, id) AS (VALUES {known}),
docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
parts AS (SELECT r, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM (
  SELECT r, string_split(regexp_replace(t, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM docs)),
hits AS (
  SELECT r, pos, id FROM (SELECT r, pos, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2A\x2C-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS norm FROM parts) p JOIN known ON regexp_replace(p.norm, 'neither the name of .{{1,160}}? nor the names of (its|their) contributors', '{license_scan.HOLDER}') = known.norm),
gaps AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) > {license_scan.GAP + 1}, false) AS apart FROM hits),
agg AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, string_agg(CASE WHEN apart THEN '<#>' ELSE '' END || '<' || id || '>', '' ORDER BY pos) AS written,
        coalesce(list(id[6:] ORDER BY pos) FILTER (id LIKE 'spdx:%'), []) AS declared FROM gaps GROUP BY r),
{steps},
named AS (SELECT r, n, ids, list_concat(declared, list_filter([{found}], lambda x: x IS NOT NULL)) AS names FROM matched{rules[-1][0]})
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses, names[1] AS best
FROM docs LEFT JOIN named USING (r)
"""


def llm_statements() -> dict[str, str]:
    return {
        "op1_url_filters": URL_FILTERS,
        "op2_chat_formatting": CHAT_FORMATTING,
        "op3_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
        "op4_benchmark_decontamination": BENCHMARK_DECONTAMINATION,
        "op6_source_mixing": SOURCE_MIXING,
        "op8_quality_rules": QUALITY_RULES,
        "op10_license_scans": license_scans(),
        "op11_source_divergence": SOURCE_DIVERGENCE,
        "op12_substring_dedup": SUBSTRING_DEDUP,
        "op13_conversation_repair": CONVERSATION_REPAIR,
    }
