"""DuckDB SQL of the longer operators."""

from __future__ import annotations

from . import quality as Q

_WORDS = "'[^\\x20\\x09-\\x0D]+'"

OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
x AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
y AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM x),
z AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM y),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM z GROUP BY doc_id, island),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(length(d.h)) // 2 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(sum(s.b - s.a), 0)::BIGINT AS n_removed, count(s.a) AS n_spans, sha256(unhex(any_value(k.h))) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.h
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _kept_of(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


def _quality() -> str:
    classes = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": " \\t\\r\\x0b\\x0c", "line": "\\n", "punctuation": ".,;:!?\\''\"()\\-\\[\\]", "symbol": "#*$%&|<>", "beyond_ascii": "\\x{80}-\\x{10FFFF}"}
    counted = ", ".join(f"{_kept_of(x)} AS {k}" for k, x in classes.items())
    histogram = f"[{', '.join(classes)}, length(t) - ({' + '.join(classes)})]"
    lists = " ".join(f"WHEN '{k}' THEN {words!r}" for k, words in Q.COMMON_WORDS.items())
    distance = lambda p, q: f"""CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
      CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END
      + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END)) / 2)) ELSE 0 END"""  # noqa: E731
    added = lambda c, n: f"[{', '.join(f'sum({c}[{i + 1}])::DOUBLE' for i in range(n))}]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws, CASE lang {lists} END AS listed FROM documents),
c AS (SELECT doc_id, {counted}, t FROM d),
h AS (SELECT doc_id, symbol, length(t) AS n_chars, {histogram}::DOUBLE[] AS classes FROM c),
u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
plain AS (SELECT doc_id, lower(trim(word, '.,;:!?"''()[]')) AS p, count(*) AS c FROM u GROUP BY ALL),
cw AS (SELECT doc_id, map_from_entries(list((p, c))) AS m FROM plain GROUP BY doc_id),
v AS (SELECT d.doc_id, d.lang, len(ws) AS n_words, list_concat(list_transform(listed, lambda x: coalesce(m[x], 0)), list_transform(range(len(listed), {Q.N_WORDS - 1}), lambda x: 0)) AS counts FROM d LEFT JOIN cw USING (doc_id)),
o AS (SELECT doc_id, CASE WHEN counts IS NULL THEN list_transform(range({Q.N_WORDS}), lambda x: 0::DOUBLE) ELSE list_concat(counts, [n_words - list_sum(counts)])::DOUBLE[] END AS common, n_words, CASE WHEN counts IS NULL THEN 'other' ELSE lang END AS reference FROM v),
win AS (SELECT doc_id, i, word || ' ' || lead(word) OVER k || ' ' || lead(word, 2) OVER k AS g FROM u WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
a AS (SELECT doc_id, o.n_words, n_chars, symbol, classes, common, reference FROM h JOIN o USING (doc_id)),
r AS (SELECT a.*, (SELECT coalesce(sum(length(word)), 0) FROM u WHERE u.doc_id = a.doc_id)::BIGINT AS word_chars, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM a LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r),
f AS (SELECT reference, {added("classes", len(Q.CLASSES))} AS rc, {added("common", Q.N_WORDS)} AS rw FROM b WHERE NOT base_failed GROUP BY reference),
j AS (SELECT b.*, {distance("classes", "rc")} AS char_distance, {distance("common", "rw")} AS word_distance FROM b LEFT JOIN f USING (reference))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, symbol::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {Q.MIN_CHARS} AND char_distance > {Q.MAX_CHAR_DISTANCE}) AND NOT (n_words > 0 AND word_distance > greatest({Q.MAX_WORD_DISTANCE}, sqrt({Q.N_WORDS - 1} / (8 * ln(2) * n_words)) + {Q.WORD_MARGIN})) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM j
"""


OP8_SQL = _quality()

OP11_SQL = """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS k
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""

# CRC-32 bit by bit: each byte goes in, then eight steps, marked -1, follow.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"""

OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []::VARCHAR[]) AS ws, {_CRC} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
d AS (SELECT doc_id, n, ws, a, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM d)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
c AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, q) >= greatest(6 - q, 3 * q)),
l AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM c),
s AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS length FROM l GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND s.q % o.q = 0 AND o.a <= s.a AND o.a + o.length >= s.a + s.length)),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.q > x.length * y.q OR (y.length * x.q = x.length * y.q AND (y.a < x.a OR (y.a = x.a AND y.q < x.q)))))),
k AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN k USING (doc_id, i) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || length || ',' || q || chr(10), '' ORDER BY a, q) AS t FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.a AS start, b.length::BIGINT AS length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
