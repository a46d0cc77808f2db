"""DuckDB twins of the queries that SQL can express."""

QUALITY_RULES = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents
), windows AS (
  SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
         coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered c USING (rid)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), measures AS (
  SELECT rid, lang, source, 'symbol_share' AS measure, n_symbols * 1000 // n_words AS v FROM base WHERE NOT base_failed
  UNION ALL SELECT rid, lang, source, 'dup_line_share', n_dup_lines * 1000 // n_lines FROM base WHERE NOT base_failed
  UNION ALL SELECT rid, lang, source, 'repeat_share', n_repeat_words * 1000 // n_words FROM base WHERE NOT base_failed
  UNION ALL SELECT rid, lang, source, 'word_length', word_chars * 10 // n_words FROM base WHERE NOT base_failed
), binned AS (
  SELECT *, (v >> greatest(length(bin(v)) - 5, 0)::BIGINT) << greatest(length(bin(v)) - 5, 0)::BIGINT AS b FROM measures
), levels AS (
  SELECT 0 AS level, lang, source, measure, b FROM binned
  UNION ALL SELECT 1, lang, NULL, measure, b FROM binned
  UNION ALL SELECT 2, NULL, NULL, measure, b FROM binned
), ranked AS (
  SELECT level, lang, source, measure, b,
         sum(count(*)) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS cum,
         sum(count(*)) OVER (PARTITION BY level, lang, source, measure) AS docs
  FROM levels GROUP BY level, lang, source, measure, b
), marks AS (
  SELECT level, lang, source, measure, any_value(docs)::BIGINT AS docs,
         min(b) FILTER (WHERE cum * 4 >= docs) AS q1, min(b) FILTER (WHERE cum * 4 >= docs * 3) AS q3,
         min(b) FILTER (WHERE cum * 1000 >= docs * 995) AS high, min(b) FILTER (WHERE cum * 1000 > docs * 5) AS low
  FROM ranked GROUP BY level, lang, source, measure
), fences AS (
  SELECT level, lang, source, measure, docs,
         CASE WHEN q3 > q1 THEN q3 + (1::BIGINT << greatest(length(bin(q3)) - 5, 0)::BIGINT) - 1 + 3 * (q3 - q1)
              ELSE high + (1::BIGINT << greatest(length(bin(high)) - 5, 0)::BIGINT) - 1 END AS most,
         CASE WHEN measure <> 'word_length' THEN 0 WHEN q3 > q1 THEN greatest(q1 - 3 * (q3 - q1), 0) ELSE low END AS least
  FROM marks
), of_lang AS (
  SELECT l.lang, l.measure, (l.docs * l.most + 50 * a.most) // (l.docs + 50) AS most, (l.docs * l.least + 50 * a.least) // (l.docs + 50) AS least
  FROM fences l JOIN fences a ON l.level = 1 AND a.level = 2 AND a.measure = l.measure
), of_group AS (
  SELECT g.lang, g.source, g.measure, (g.docs * g.most + 50 * l.most) // (g.docs + 50) AS most, (g.docs * g.least + 50 * l.least) // (g.docs + 50) AS least
  FROM fences g JOIN of_lang l ON g.level = 0 AND l.measure = g.measure AND l.lang IS NOT DISTINCT FROM g.lang
), judged AS (
  SELECT m.rid, bool_and(m.v BETWEEN g.least AND g.most) AS within
  FROM measures m JOIN of_group g ON g.measure = m.measure AND g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source
  GROUP BY m.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(within, false) AS kept
FROM base LEFT JOIN judged USING (rid)
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, hash(w[i : i + 4]) AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), common AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE c >= 0.8 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT rid, rid FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT x.doc_id, (SELECT min(y.doc_id) FROM reach JOIN w y ON y.rid = reach.b WHERE reach.a = x.rid) AS class_id,
       (SELECT count(*) FROM link WHERE link.a = x.rid) AS n_links
FROM w x
"""

WARC_FIXITY = r"""
WITH recs AS (
  SELECT page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, sha256(coalesce(url, '') || chr(10) || coalesce(html, '')))
    || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM pages
), hashed AS (
  SELECT page_id, record, octet_length(record)::BIGINT AS length, sha256(record) AS digest FROM recs
), placed AS (
  SELECT *, coalesce(sum(length) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM hashed
), filed AS (
  SELECT *, pos // 67108864 AS file, pos - min(pos) OVER (PARTITION BY pos // 67108864) AS offset_, substr(digest, 1, 2) AS rule FROM placed
), more AS (
  SELECT *, coalesce(sum(length) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM filed WHERE rule BETWEEN '18' AND '1f'
)
SELECT file, offset_ AS offset, length, digest,
       CASE WHEN rule <= '07' THEN sha256(unhex('00' || substr(hex(record), 3))) WHEN rule >= '10' THEN sha256(unhex(substr(hex(record), 1, 2 * length::INT - 2))) END AS found_digest,
       CASE WHEN rule BETWEEN '08' AND '0f' THEN 'missing' ELSE 'changed' END AS fault
FROM filed WHERE rule <= '17'
UNION ALL
SELECT (SELECT max(file) FROM filed) + 1 + place // 67108864, place - min(place) OVER (PARTITION BY place // 67108864), length, NULL, digest, 'extra' FROM more
"""
