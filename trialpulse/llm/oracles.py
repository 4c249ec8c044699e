"""DuckDB SQL of the queries that SQL can express, by plain definitions."""

from __future__ import annotations

from . import linerules as _lines

_SPACE = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _fold(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_UPPER.lower()}')"


def _windows(source: str, key: str, width: str) -> str:
    """Rows (key, s, win) of all windows of a list column w."""
    return f"SELECT {key}, s, array_to_string(list_slice(w, s, s + {width} - 1), ' ') AS win FROM (SELECT {key}, w, unnest(range(1, len(w) - {width} + 2)) AS s FROM {source} WHERE len(w) >= {width})"


OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_fold("COALESCE(text, '')")}, '{_SPACE}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, win FROM ({_windows("d", "doc_id", "5")}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.win = y.win AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT v AS doc_id, COALESCE(any_value(n.n), 0) AS n_shingles, min(u) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.v GROUP BY v"""

OP4 = """WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages), m AS (SELECT body, max(page_id) AS last FROM p GROUP BY body),
b AS (SELECT page_id, body, last, unhex(sha1(body)) AS digest FROM p JOIN m USING (body)),
bits AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(CAST('0x' || substring(hex(digest), i + 1, 1) AS INT)), 4, '0')), '') AS z FROM b)
SELECT page_id, octet_length(encode(body)) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(1, 6), lambda j: CAST(substring(z, 5 * i + j, 1) AS INT)), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM bits"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_fold("COALESCE(text, '')")}, '{_ITEM}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_fold("COALESCE(text, '')")}, '{_ITEM}') AS w FROM benchmark),
b AS (SELECT item, LEAST(10, len(w)) AS k, unnest(range(1, GREATEST(len(w) - 9, 1) + 1)) AS s, w FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM b),
lens AS (SELECT DISTINCT k FROM wins),
e AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k),
t AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM e),
h AS (SELECT t.doc_id, t.k, t.s, item FROM t JOIN wins ON t.k = wins.k AND t.win = wins.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""

OP7 = """WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 400)) AS win FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 199)) AS s FROM d WHERE len(h) >= 400)),
r AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
k AS (SELECT doc_id, s FROM w WHERE win IN (SELECT win FROM r)),
o AS (SELECT doc_id, s, CASE WHEN s > COALESCE(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, -1) THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM runs GROUP BY doc_id),
j AS (SELECT d.doc_id, h, COALESCE(removed, 0) AS removed, COALESCE(spans, 0) AS spans, list_concat(COALESCE(starts, []), [CAST(len(h) / 2 AS BIGINT)]) AS upto, list_concat([0], COALESCE(ends, [])) AS since FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(upto) + 1), lambda i: substring(h, CAST(2 * since[i] + 1 AS BIGINT), CAST(2 * (upto[i] - since[i]) AS BIGINT))), ''))) AS kept_sha256 FROM j"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_SPACE}') AS w FROM documents),
t AS ({_windows("d", "doc_id", "50")}), m AS (SELECT md5(win) AS m, min(doc_id) AS least FROM t GROUP BY 1),
h AS (SELECT doc_id, s FROM t JOIN m ON md5(win) = m WHERE doc_id > least),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(s, s + 50)) AS q FROM h) GROUP BY doc_id),
f AS (SELECT d.doc_id, w, COALESCE(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, list(x ORDER BY q) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM f) y WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS q FROM f) z WHERE z.doc_id = y.doc_id AND z.q = y.q) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(COALESCE(array_to_string(kept, ' '), '')) AS kept_sha256 FROM f LEFT JOIN k USING (doc_id)"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _codes(rounds: int = 6) -> str:
    """Assignments a0, books b1, .. as one step after another."""
    out = []
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, part, min(16 * d + entry) % 16 AS entry, min(16 * d + entry) // 16 AS d FROM (SELECT x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{i} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY vec_id, part)")
        if i < rounds:
            out.append(f"m{i} AS (SELECT x.part, a.entry, pos, sum(c) AS s, count(*) AS n FROM x JOIN a{i} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL)")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, COALESCE((s - ((s % n) + n) % n) // n, c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)")
    return ",\n".join(out)


OP11 = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos, e[i] AS c FROM (SELECT vec_id, e, len(e) // 8 AS w, unnest(range(1, len(e) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, entry, pos, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16) f USING (vec_id)),
{_codes()},
e AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b6)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"""


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP12 = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{_SPACE}') AS w FROM documents),
l AS (SELECT doc_id, line, regexp_extract_all(line, '{_SPACE}') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT doc_id, line, len(w) AS n, (regexp_matches(w[-1], {_text(_lines.ENDING)}) OR {_lines.SENTENCE} * len(list_filter(w, lambda x: regexp_matches(x, {_text(_lines.ENDING)}))) >= len(w)) AND 100 * len(list_filter(w, lambda x: x IN ({', '.join(map(_text, _lines.SEPARATORS))}))) <= {_lines.SEPARATED} * len(w)
  AND 100 * len(list_filter(w, lambda x: regexp_matches(x, {_text(_lines.SHOUT)}))) <= {_lines.SHOUTED} * len(w) AND 100 * len(regexp_extract_all(line, {_text(_lines.SYMBOL)})) <= {_lines.SYMBOLS} * length(array_to_string(w, ''))
  AND NOT (len(w) <= {_lines.SHORT} AND regexp_matches(line, {_text(_lines.phrase(_lines.MENU))})) AND NOT (len(w) <= {_lines.LONG} AND regexp_matches(line, {_text(_lines.phrase(_lines.BOILERPLATE))})) AS good FROM l WHERE len(w) > 0),
p AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (NOT good) AS failed, COALESCE(sum(n) FILTER (NOT good), 0) AS lost FROM j GROUP BY doc_id),
t AS ({_windows("d", "doc_id", "8")}),
r AS (SELECT doc_id, count(DISTINCT q) AS again FROM (SELECT doc_id, unnest(range(s, s + 8)) AS q FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, {_text(_lines.SYMBOL)})) AS BIGINT) AS n_symbols, CAST(COALESCE(dup, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(again, 0) AS BIGINT) AS n_repeat_words, CAST(COALESCE(failed, 0) AS BIGINT) AS n_failed_lines, CAST(COALESCE(lost, 0) AS BIGINT) AS n_lost_words FROM d LEFT JOIN p USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= {_lines.LOST} * n_words AS kept FROM f"""

_CRC = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, x: list_reduce(range(8), lambda b, y: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295), 4294967295)"
OP13 = f"""WITH t AS (SELECT conv_id, list({{'r': COALESCE(role, ''), 't': COALESCE(text, '')}} ORDER BY turn NULLS FIRST) AS q FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, q, {_CRC} % 4 AS h FROM t),
c AS MATERIALIZED (SELECT h.conv_id, list_concat(COALESCE(list_slice(b.q, 1, h), []), list_slice(h.q, h + 1, len(h.q))) AS q FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, d, md5(CAST(list_slice(q, 1, d) AS VARCHAR) || '/' || d) AS name, len(q) AS n, CASE WHEN d > 0 THEN len(regexp_extract_all(q[d].t, '{_SPACE}')) ELSE 0 END AS words FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM c)),
m AS MATERIALIZED (SELECT name, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY name, d),
u AS (SELECT m.name, o.name AS parent, up.conv_id AS parent_conv_id FROM m JOIN p o ON o.conv_id = m.conv_id AND o.d = m.d - 1 JOIN m up ON up.name = o.name),
k AS (SELECT parent AS name, count(*) AS n_children FROM u GROUP BY parent),
s AS (SELECT o.name, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens FROM m JOIN p o ON o.conv_id = m.conv_id AND o.d <= m.d LEFT JOIN k ON k.name = m.name GROUP BY o.name)
SELECT m.conv_id, m.d AS depth, parent_conv_id, n_convs, COALESCE(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM m JOIN s USING (name) LEFT JOIN k USING (name) LEFT JOIN u USING (name)"""
