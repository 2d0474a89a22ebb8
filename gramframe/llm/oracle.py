"""DuckDB forms of the operators that SQL can express, written from their definitions."""

_NOTICES = "', '".join([
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "click here", "enable javascript", "sign up for", "subscribe to our", "back to top", "general public license"])

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM tri, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY doc_id),
ln AS (
  SELECT doc_id, line, {_WORDS.format("line")} AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, line, len(lw) AS n,
    len(regexp_extract_all(line, '[#*$%&|<>]')) * 100 > length(line) * 8
    OR (len(regexp_extract_all(line, '[!?]')) >= 3 AND len(regexp_extract_all(line, '[!?]')) * 3 >= len(lw))
    OR (len(regexp_extract_all(line, '[|»›·]')) >= 2 AND len(regexp_extract_all(line, '[|»›·]')) * 4 >= len(lw))
    OR (len(lw) < 25 AND list_bool_or(list_transform(['{_NOTICES}'], lambda p: contains(lower(line), p))))
    OR (len(lw) >= 10 AND len(list_distinct(lw)) * 4 < len(lw))
    OR (len(lw) < 3 AND NOT regexp_matches(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?:;。！？：；…]$')) AS fails
  FROM ln),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM judged GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS n_kept_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - n_kept_words) * 100 > n_words * 50) AS kept, n_kept_words
FROM r
"""

OP5 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT doc_id, seq, line, n, lead(line, 1) OVER p AS l2, lead(line, 2) OVER p AS l3, n + lead(n, 1) OVER p AS n2 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY seq)),
f AS (SELECT doc_id, seq, 3 AS len, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, seq) AS k FROM t WHERE l3 IS NOT NULL
      UNION ALL SELECT doc_id, seq, 2, row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, seq) FROM t WHERE l2 IS NOT NULL AND n2 >= 50
      UNION ALL SELECT doc_id, seq, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) FROM t WHERE n >= 50),
g AS (SELECT DISTINCT doc_id, seq + o AS seq FROM f, (VALUES (0), (1), (2)) v(o) WHERE k > 1 AND o < len),
n AS (SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (new) AS n_runs
      FROM (SELECT doc_id, coalesce(lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) < seq - 1, true) AS new FROM g) GROUP BY doc_id),
r AS (SELECT l.doc_id, l.pos, l.line, w.seq, g.seq IS NOT NULL AS gone FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.pos = w.pos
      LEFT JOIN g ON w.doc_id = g.doc_id AND w.seq = g.seq),
k AS (SELECT doc_id, count(seq) AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# crc32 by its table (built from the polynomial 0xEDB88320) over the bytes of every distinct feature
OP12 = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (
  SELECT side, id, array_to_string(ws[i:i + k - 1], ' ') AS feature
  FROM (SELECT side, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws)),
held AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
hexed AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM held)),
crc AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
  FROM hexed, tab),
b AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM held JOIN crc USING (feature) GROUP BY ALL),
tot AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM b GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g
  FROM tot, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM tot)),
doc AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM b JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN doc ON doc.id = w.id WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

# The exponent by the same 42 halvings; the ratio of the extreme sources decides how often the smallest share is read.
OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, source IS NULL AS none, coalesce(source, '') AS name, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS n_tokens FROM documents),
s AS (SELECT none, name, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY none, name),
tot AS (SELECT sum(tokens) AS total, min(tokens) FILTER (tokens > 0) AS least, max(tokens) AS most FROM s),
halving AS (
  SELECT 0 AS k, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT *, pow(least / total, (lo + hi) / 2 - 1) / pow(most / total, (lo + hi) / 2 - 1) <= 2 AS ok FROM halving, tot WHERE k < 42)),
alpha AS (SELECT CASE WHEN pow(least / total, -1) / pow(most / total, -1) <= 2 THEN 0 ELSE hi END AS a FROM halving, tot WHERE k = 42),
plan AS (
  SELECT none, name, tokens, floor(epochs)::BIGINT AS whole, floor((epochs - floor(epochs)) * tokens)::BIGINT AS rest
  FROM (SELECT *, CASE WHEN tokens > 0 THEN round(pow(tokens / total, a - 1) / pow(most / total, a - 1), 9) ELSE 1 END AS epochs FROM s, tot, alpha)),
placed AS (
  SELECT d.*, whole, rest, ('0x' || substr(md5(concat_ws('~', 'mix', coalesce(doc_id::VARCHAR, 'none'), whole, none, name)), 1, 15))::BIGINT AS place
  FROM d JOIN plan USING (none, name)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY none, name ORDER BY place) AS run FROM placed),
ends AS (SELECT none, name, max(place) AS last FROM upto WHERE rest > 0 AND run <= rest GROUP BY none, name)
SELECT doc_id, source, n_tokens, unnest(range(0, whole + CASE WHEN rest > 0 AND place <= coalesce(last, -1) THEN 1 ELSE 0 END))::INTEGER AS epoch
FROM placed LEFT JOIN ends USING (none, name)
"""
