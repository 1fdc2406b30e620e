"""DuckDB SQL for the queries of this subpackage that SQL can express."""

# Source divergence: dense tables of all groups and kept terms, in HUGEINT arithmetic.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM cl JOIN v USING (lang)),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (gn.total + 5 * v.v)::HUGEINT AS p
  FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term
  WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

# Chat formatting: the digests from the turns themselves, the sizes from the windows laid out again
# (budget 1024, history 128 tokens and 8 turns, stretches of 320 tokens, blocks of 512 turn numbers).
OP12 = r"""
WITH c AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, turn // 512 AS block, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}{1,3}|[^\x{09}-\x{0D}\x{20}\p{L}\p{M}\p{N}]')) + 4 AS tokens,
         12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS chars
  FROM c),
r AS (
  SELECT *, block AS b, false AS carried FROM t
  UNION ALL SELECT *, block + 1 AS b, true AS carried FROM t WHERE turn % 512 >= 504),
s AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id, b ORDER BY k ROWS UNBOUNDED PRECEDING) - tokens AS start FROM r),
p AS (SELECT *, CASE WHEN NOT carried THEN (start // 320) * 2 + (tokens > 320)::INTEGER END AS place FROM s),
w AS (SELECT conv_id, b, place, min(start) AS begins, min(turn) AS since FROM p WHERE place IS NOT NULL GROUP BY ALL),
m AS (
  SELECT w.conv_id, w.b, w.place, sum(p.chars) AS chars, min(p.k) AS k
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.b = w.b
  WHERE p.place = w.place OR (p.start < w.begins AND w.begins <= p.start + 128 AND p.turn >= w.since - 8)
  GROUP BY ALL),
sized AS (
  SELECT m.conv_id, count(*) AS n_windows, sum(m.chars + CASE WHEN m.k > 1 THEN coalesce(t.chars, 0) ELSE 0 END) AS formatted_chars
  FROM m LEFT JOIN t ON t.conv_id = m.conv_id AND t.k = 1 AND t.role = 'system' GROUP BY ALL)
SELECT t.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars)::BIGINT AS formatted_chars, any_value(n_windows) AS n_windows
FROM t JOIN sized USING (conv_id) GROUP BY t.conv_id
"""

# Substring dedup: every window of 20 words as a string; all but the first of equal ones cover their words.
OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM w, unnest(range(1, len(words) - 18)) AS u(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, i + o AS k FROM dup, range(0, 20) AS r(o)),
word AS (SELECT doc_id, k, words[k] AS word FROM w, unnest(range(1, len(words) + 1)) AS u(k)),
rest AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
  FROM word WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = word.doc_id AND c.k = word.k) GROUP BY word.doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN rest USING (doc_id)
"""

# Suffix dedup: every string of 400 bytes, as hexadecimal digits; all of equal ones cover their bytes.
OP3 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (  -- pieces in which 512 strings begin
  SELECT doc_id, 512 * c AS base, substring(h, 1024 * c + 1, 1824) AS h, length(h) // 2 AS n FROM h, unnest(range(0, length(h) // 1024 + 1)) AS u(c)),
s AS (SELECT doc_id, base + i AS i, md5(substring(h, 2 * i + 1, 800)) AS key FROM c, unnest(range(0, least(512, n - 399 - base))) AS u(i)),
dup AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY key) > 1),
edges AS (  -- the first and last of neighbouring strings
  SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM dup),
runs AS (SELECT doc_id, i, sum((gap > 400)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY ALL),
per AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT h.doc_id, coalesce(max(b), 0), max(length(h)) // 2 FROM h LEFT JOIN spans USING (doc_id) GROUP BY h.doc_id),
rest AS (SELECT h.doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN per USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

# Near-duplicates: a join of all shingles, and the smallest document that links reach.
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
class AS (SELECT b AS doc_id, min(a) AS a FROM l WHERE same GROUP BY b)
SELECT comp.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, comp.doc_id = component_id AS kept,
       least(comp.doc_id, coalesce(class.a, comp.doc_id)) AS class_id
FROM comp LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)
"""
