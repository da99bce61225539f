"""SQL of text operators whose rows plain SQL can state: repeated 100-byte strings, linked sets, licences.

It states the contracts directly (every window, every pair with a common shingle, every term of every header) and so
suits small tables only. The given tables have one row an id; the SQL rests on that.
"""

from __future__ import annotations

from . import common, licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, len(h) // 2 AS n, k, substr(h, 1000 * k + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 999) // 1000)) AS k FROM docs)),
places AS (SELECT doc_id, n, k, h, unnest(range(0, least(500, n - 500 * k))) AS j FROM parts),
windows AS (SELECT doc_id, 500 * k + j AS i, substr(h, 2 * j + 1, 2) AS byte, CASE WHEN 500 * k + j + 100 <= n THEN md5(substr(h, 2 * j + 1, 200)) END AS w FROM places),
repeats AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM windows),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM repeats),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS rest FROM edged GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{common.WORD_PATTERN}') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM worded),
runs AS (SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingled AS (SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM runs WHERE i <= greatest(n - 4, 1) GROUP BY doc_id),
sets AS (SELECT doc_id, coalesce(s, []) AS s FROM worded LEFT JOIN shingled USING (doc_id)),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
cells AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b FROM cells a JOIN cells b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON least.a = classes.c
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matched(name: str, found: str, against: tuple) -> str:
    """CTEs that end in `name`: (file_id, no, n_words, license, cosine) of each header's best template."""
    templates = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(against))
    terms = f"unnest(regexp_extract_all(lower({{}}), {_quoted(licenses._TERM)}))"
    return f"""
{name}_tf AS (SELECT file_id, no, term, count(*) AS tf FROM (SELECT file_id, no, {terms.format("header")} AS term FROM {found}) GROUP BY ALL),
{name}_idf AS (SELECT term, ln(1.0 + ((SELECT count(*) FROM {found}) + 1)::DOUBLE / (1.0 + count(*))) AS idf FROM {name}_tf GROUP BY term),
{name}_none AS (SELECT ln(1.0 + ((SELECT count(*) FROM {found}) + 1)::DOUBLE) AS idf),
{name}_ttf AS (SELECT i, license, term, count(*) AS tf FROM (SELECT i, license, {terms.format("text")} AS term FROM (VALUES {templates}) v(i, license, text)) GROUP BY ALL),
{name}_tw AS (SELECT i, license, t.term, tf * coalesce(k.idf, (SELECT idf FROM {name}_none)) AS w FROM {name}_ttf t LEFT JOIN {name}_idf k ON t.term = k.term),
{name}_hw AS (SELECT file_id, no, t.term, tf * idf AS w FROM {name}_tf t JOIN {name}_idf k ON t.term = k.term),
{name}_cos AS (SELECT h.file_id, h.no, t.i, t.license, sum(h.w * t.w) AS dot FROM {name}_hw h JOIN {name}_tw t ON h.term = t.term GROUP BY ALL),
{name}_scored AS (SELECT c.file_id, c.no, c.i, c.license, round(dot / hn / tn, 9) AS cosine FROM {name}_cos c
    JOIN (SELECT file_id, no, sqrt(sum(w * w)) AS hn FROM {name}_hw GROUP BY ALL) x ON x.file_id = c.file_id AND x.no = c.no
    JOIN (SELECT i, sqrt(sum(w * w)) AS tn FROM {name}_tw GROUP BY i) y ON y.i = c.i),
{name} AS (SELECT b.file_id, b.no, len(regexp_split_to_array(trim(header, ' '), '[ \\t\\n\\x0B\\f\\r]+')) AS n_words, license, cosine
    FROM (SELECT * FROM {name}_scored QUALIFY row_number() OVER (PARTITION BY file_id, no ORDER BY cosine DESC, i) = 1) b JOIN {found} f ON f.file_id = b.file_id AND f.no = b.no)"""


def license_scan(least: float = 0.6, least_whole: float = 0.8) -> str:
    cue, name = _quoted(licenses.CUE), _quoted(licenses.NAME)
    # A sentence ends at each newline and at blanks behind its mark, where these do not begin with a newline.
    sentences = "string_split(regexp_replace(text, '([.!?])[ \\t\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(10), 'g'), chr(10))"
    return f"""
WITH files AS (SELECT doc_id AS file_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path, text FROM documents),
dirs AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
sentences AS (SELECT file_id, list_filter({sentences}, lambda s: regexp_matches(s, {cue})) AS l FROM files WHERE regexp_matches(text, {cue})),
heads AS (SELECT file_id, no, l[no] AS header FROM (SELECT file_id, l, unnest(range(1, len(l) + 1)) AS no FROM sentences)),
texts AS (SELECT file_id, 0 AS no, text AS header FROM files WHERE regexp_matches(text, {cue}) OR regexp_matches(path, {name})),
{_matched("head", "heads", licenses.TEMPLATES)},
{_matched("whole", "texts", licenses.full_texts())},
by_head AS (SELECT file_id, arg_max(license, {{'c': cosine, 'n': -no, 'l': license}}) AS license, max(cosine) AS cosine, sum(n_words) AS header_words FROM head WHERE cosine >= {least} GROUP BY file_id),
by_text AS (SELECT file_id, license, cosine FROM whole WHERE cosine >= {least_whole}),
judged AS (SELECT d.file_id, d.path, d.dir, coalesce(t.license, h.license) AS license, coalesce(t.cosine, h.cosine) AS cosine,
        t.license IS NOT NULL OR regexp_matches(d.path, {name}) OR 2 * coalesce(h.header_words, 0) >= len(regexp_extract_all(coalesce(d.text, ''), '{common.WORD_PATTERN}')) AS is_file
    FROM dirs d LEFT JOIN by_head h ON h.file_id = d.file_id LEFT JOIN by_text t ON t.file_id = d.file_id),
of_dir AS (SELECT dir AS up, arg_min(license, {{'c': -cosine, 'p': path}}) AS dir_license FROM judged WHERE license IS NOT NULL AND is_file GROUP BY dir),
near AS (SELECT dir, arg_max({{'up': up, 'license': dir_license}}, len(up)) AS n FROM (SELECT DISTINCT dir FROM judged WHERE license IS NULL) JOIN of_dir ON up = '' OR up = dir OR starts_with(dir, up || '/') GROUP BY dir)
SELECT file_id AS doc_id, path, license AS own_license, cosine, coalesce(license, n.license) AS license, CASE WHEN license IS NULL THEN n.up END AS license_dir
FROM judged LEFT JOIN near USING (dir)
"""


LICENSE_SCAN = license_scan()
