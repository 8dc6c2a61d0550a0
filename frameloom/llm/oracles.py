"""SQL (for DuckDB) with the same results as the queries that SQL can express."""

from __future__ import annotations

from frameloom.llm import decontam, line_dedup, pii, quality_rules

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
N = decontam.WINDOW

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + {N} - 1], ' ') AS win, least(len(w), {N}) AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r.doc_id, i, r.k, item FROM runs r JOIN win ON win.win = r.win AND win.k = r.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in quality_rules.BOILERPLATE)
_BARS = ", ".join(f"'{b}'" for b in quality_rules.BARS)
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '{SPACED}') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACED}')),
judged AS (SELECT doc_id, line, len(w) AS n, len(regexp_extract_all(line, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]')) AS odd, length(array_to_string(w, '')) AS dense,
  len(list_filter(w, lambda x: regexp_matches(x, '[!?#$%&*]{{2}}$'))) AS loud, len(list_filter(w, lambda x: x IN ({_BARS}))) AS bars, {_PHRASES} AS furniture FROM lines),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (odd * 100 > dense * 30 OR (n >= 3 AND loud * 2 > n) OR (bars >= 2 AND n - bars <= 3 * (bars + 1)) OR furniture), 0) AS lost FROM judged GROUP BY 1),
out AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words) AND 100 * n_lost_words <= {quality_rules.MOST_LOST_PERCENT} * n_words AS kept FROM out
"""

# Near lines share a run of four words: with k edits and 8 k or more words, one of k + 1 stretches is untouched. The edit
# distance is a fold over the first line's words: x holds the row that comes from above and from the diagonal, and a
# running least adds what comes from the left.
LINES = rf"""
WITH l AS (SELECT doc_id, no - 1 AS no, trim(lines[no], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
f AS (SELECT line, min((doc_id, no)) AS pos FROM l WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]') GROUP BY 1),
w AS (SELECT *, len(ws) AS n, row_number() OVER () AS id FROM (SELECT line, pos, regexp_extract_all(line, '[^\x20\t\x0b\x0c\r]+') AS ws FROM f) WHERE len(ws) >= {line_dedup.EDIT_WORDS}),
g AS (SELECT DISTINCT id, array_to_string(ws[i:i + 3], ' ') AS gram FROM (SELECT id, ws, unnest(range(1, n - 2)) AS i FROM w)),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM g a JOIN g b USING (gram) WHERE a.id <> b.id),
p AS (SELECT y.line, x.ws AS xs, y.ws AS ys, least(least(x.n, y.n) // {line_dedup.EDIT_WORDS}, {line_dedup.MOST_EDITS}) AS k FROM c JOIN w x ON x.id = c.a JOIN w y ON y.id = c.b WHERE x.pos < y.pos AND abs(x.n - y.n) <= least(least(x.n, y.n) // {line_dedup.EDIT_WORDS}, {line_dedup.MOST_EDITS})),
e AS (SELECT line, k, list_reduce(list_transform(xs, lambda v: list_transform(ys, lambda u: (u <> v)::INT)), lambda r, m: list_transform(range(0, len(r)), lambda j: (j + list_min(list_transform(range(0, j + 1), lambda i: CASE WHEN i = 0 THEN r[1] + 1 ELSE least(r[i + 1] + 1, r[i] + m[i]) - i END)))::INT), list_transform(range(0, len(ys) + 1), lambda i: i::INT))[len(ys) + 1] AS d FROM p),
near AS (SELECT DISTINCT line FROM e WHERE d <= k),
gone AS (SELECT doc_id, count(DISTINCT no) AS n, list_sort(list(DISTINCT no)) AS nos FROM l JOIN f USING (line) LEFT JOIN (SELECT line, true AS near FROM near) USING (line) WHERE near OR (doc_id, no) > pos GROUP BY 1)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(n, 0) AS n_removed, coalesce(array_to_string(nos, ','), '') AS removed_lines FROM documents d LEFT JOIN gone USING (doc_id)
"""

#: The base kinds in their plain forms.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS rank, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS bs FROM d" for i, (k, p) in enumerate(_KINDS.items()))
_PLACE = "(list_sum(list_transform(bs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT"
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '')"
PERSONAL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS (SELECT doc_id, kind, rank, ms[k] AS v, {_PLACE} AS s, regexp_replace(ms[k], '[^0-9]', '', 'g') AS dg FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ({_FOUND}))),
base AS (SELECT doc_id, kind, rank, v, dg, s, s + length(v) AS e FROM hits WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 256) > 255)) = 0
  WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(dg)), lambda i: CASE WHEN i % 2 = 0 THEN substr(dg, length(dg) - i, 1)::INT WHEN substr(dg, length(dg) - i, 1)::INT > 4 THEN 2 * substr(dg, length(dg) - i, 1)::INT - 9 ELSE 2 * substr(dg, length(dg) - i, 1)::INT END)) % 10 = 0
  WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15 ELSE true END),
ent AS (SELECT doc_id, kind, v, s, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN dg ELSE lower(v) END AS exact,
  CASE kind WHEN 'email' THEN lower(split_part(v, '@', 2)) WHEN 'ip' THEN split_part(v, '.', 1) || '.' || split_part(v, '.', 2) WHEN 'card' THEN substr(dg, 1, 6) ELSE substr(dg, 1, 4) END AS wide,
  CASE WHEN kind = 'email' THEN regexp_replace(lower(split_part(v, '@', 1)), '[^a-z]', '', 'g') ELSE '' END AS usr FROM base),
held AS (SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, unnest([exact, 'in ' || kind || ':' || wide, CASE WHEN length(usr) >= 3 THEN 'user:' || usr END]) AS entity FROM ent) WHERE entity IS NOT NULL),
ents AS (SELECT entity, count(*) AS n_entity, count(DISTINCT text) AS n_texts FROM held JOIN d USING (doc_id) GROUP BY 1),
docs AS (SELECT doc_id, text, list_distinct(list_transform(regexp_extract_all(text, '\p{{L}}{{3,}}'), lambda x: lower(x))) AS ws FROM d),
pairs AS (SELECT entity, term, count(*) AS n_both, count(DISTINCT text) AS k FROM (SELECT entity, text, unnest(ws) AS term FROM held JOIN ents USING (entity) JOIN docs USING (doc_id) WHERE n_texts > 1) GROUP BY ALL),
terms AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(ws) AS term FROM docs) GROUP BY 1),
told AS (SELECT entity, term FROM pairs JOIN ents USING (entity) JOIN terms USING (term), (SELECT count(*) AS n FROM d) WHERE n > n_entity AND round(log2(n * n_both / (n_term * n_entity)) / log2(n / n_entity) * (k / (k + 1)), 9) >= {pii.THRESHOLD}),
marked AS (SELECT doc_id, list(DISTINCT term) AS terms FROM held JOIN told USING (entity) GROUP BY 1),
runs AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, terms, regexp_extract_all(text, '\p{{L}}{{3,}}') AS ms, string_split_regex(text, '\p{{L}}{{3,}}') AS bs FROM marked JOIN d USING (doc_id))),
found AS (SELECT doc_id, {_PLACE} AS s, ms[k] AS w FROM runs WHERE list_contains(terms, lower(ms[k]))),
extra AS (SELECT doc_id, 'term' AS kind, {len(_KINDS)} AS rank, s, s + length(w) AS e FROM found WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = found.doc_id AND found.s < b.e AND b.s < found.s + length(w))),
per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, {_LIST} AS spans FROM base GROUP BY 1),
label AS (SELECT ent.doc_id, ent.kind, ent.s, '[' || upper(kind) || CASE WHEN n > x.n_entity AND round(log2(n / w.n_entity) / log2(n / x.n_entity), 9) < {pii.THRESHOLD} THEN ' ' || wide ELSE '' END || ']' AS label
  FROM ent JOIN ents x ON x.entity = exact JOIN ents w ON w.entity = 'in ' || kind || ':' || wide, (SELECT count(*) AS n FROM d)),
spans AS (SELECT doc_id, kind, rank, s, e, label FROM base JOIN label USING (doc_id, kind, s) UNION ALL SELECT doc_id, kind, rank, s, e, '[TERM]' FROM extra),
every AS (SELECT doc_id, {_LIST} AS spans, string_agg(CASE WHEN s < done THEN '' ELSE substr(text, done + 1, s - done) || label END, '' ORDER BY s, rank, e) || substr(any_value(text), max(e) + 1) AS clean
  FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM spans JOIN d USING (doc_id)) GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(per.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans, sha256(coalesce(clean, text)) AS clean_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN every USING (doc_id)
"""

ORACLES = {"op2_benchmark_decontamination": DECONTAMINATION, "op3_quality_rules": QUALITY, "op5_line_dedup": LINES, "op9_personal_data": PERSONAL}
