"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (SELECT *, trim({LOW.format('line')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key
GROUP BY k.doc_id
"""


def _op4() -> str:
    from .license_scan import BASE, INDEX, MIN_VOTES, WORD

    values = ", ".join(f"({t}, '{label}', {p}, '{w}', {k}, {r})" for t, label, p, w, k, r in INDEX)
    base = " UNION ALL ".join(
        f"SELECT doc_id, i AS start, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM f) "
        "WHERE " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in BASE.items())
    low = LOW.format("coalesce(text, '')")
    return rf"""
WITH f AS (SELECT doc_id, regexp_extract_all({low}, '{WORD}') AS w FROM documents),
t(tid, label, tpos, word, is_key, is_rare) AS (VALUES {values}),
need AS (SELECT tid, least({MIN_VOTES}, count(*) FILTER (WHERE is_rare)) AS votes,
         count(*) FILTER (WHERE is_key) AS n_key, count(*) AS n_all FROM t GROUP BY tid),
h AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM f),
placed AS (
  SELECT doc_id, t.tid, t.label, pos - tpos AS start, count(*) AS m,
         count(*) FILTER (WHERE is_key) AS k, count(*) FILTER (WHERE is_rare) AS votes
  FROM h JOIN t ON h.word = t.word GROUP BY ALL),
verified AS (
  SELECT doc_id, label, m / n_all AS score FROM placed JOIN need ON placed.tid = need.tid
  WHERE placed.k = need.n_key AND placed.votes >= need.votes),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
      (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM verified) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM verified GROUP BY doc_id)
SELECT f.doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       coalesce(s.score, CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM f LEFT JOIN b ON f.doc_id = b.doc_id LEFT JOIN a ON f.doc_id = a.doc_id LEFT JOIN s ON f.doc_id = s.doc_id
"""


OP4 = _op4()

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.seen = u.a),
c AS (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.c, n.doc_id) AS component_id,
       coalesce(c.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON n.doc_id = c.doc_id
"""

_ANGLE = r"<(\\*)(\|turn\|>|\|say\|>|\|end\|>|/s>)"
_SQUARE = r"\[(\\*)(INST\]|/INST\])"


def _escaped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_ANGLE}', '<\\1\\\\\\2', 'g'), '{_SQUARE}', '[\\1\\\\\\2', 'g')"


OP6 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|say|><|end|>') + 1 + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT
         AS formatted_chars
FROM c GROUP BY conv_id
"""


def _crc32(x: str) -> str:
    """CRC-32 of a text, unsigned, as SQL."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), "
            "lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), "
            "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)")


OP11 = rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         {_crc32('doc_id::VARCHAR')} AS h FROM documents),
p AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM q)),
often AS (SELECT doc_id, word FROM words GROUP BY 1, 2 HAVING count(*) >= 4),
frequent AS (SELECT words.* FROM words JOIN often USING (doc_id, word)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM frequent x JOIN frequent y
         ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS s FROM same)
  GROUP BY doc_id, q, s HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretch x WHERE NOT EXISTS (
  SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.start <= x.start
  AND y.start + y.length >= x.start + x.length)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) AS place FROM runs),
sums AS (SELECT doc_id, count(*) AS n_runs,
         string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS listed FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.q AND x.i < r.start + r.length)
  GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length,
       b.q::BIGINT AS period, ((1000 * b.length) // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
     LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id)
"""

OP12 = rf"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('conv_id::VARCHAR')} % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
path AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars,
         sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER w) AS key
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT d, key, min(conv_id) AS top, count(*) AS n, min(chars) AS chars FROM path GROUP BY d, key),
up AS (SELECT u.d, u.key, m.key AS pkey, m.top AS parent FROM node u
       JOIN path x ON x.conv_id = u.top AND x.d = u.d - 1 JOIN node m ON m.d = x.d AND m.key = x.key),
kids AS (SELECT d - 1 AS d, pkey AS key, count(*) AS k FROM up GROUP BY 1, 2),
sub AS (SELECT x.d, x.key, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((u.n - 1) * u.chars) AS saved
        FROM node u LEFT JOIN kids ON kids.d = u.d AND kids.key = u.key
        JOIN path x ON x.conv_id = u.top AND x.d <= u.d GROUP BY 1, 2),
ends AS (SELECT d, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM path JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY 1) USING (conv_id, d) GROUP BY d, key)
SELECT node.top AS conv_id, node.d AS depth, up.parent AS parent_conv_id, n AS n_convs,
       coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sub USING (d, key) LEFT JOIN up USING (d, key) LEFT JOIN kids USING (d, key) LEFT JOIN ends USING (d, key)
"""
