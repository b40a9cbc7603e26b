"""SQL that computes the same as some of the queries, on its own, for DuckDB."""

from __future__ import annotations

from .pii import IBAN_LENGTHS

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH d AS (SELECT doc_id, {_LOWER.format(t="coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.v, '.'), lambda p: TRY_CAST(p AS BIGINT) IS NULL OR CAST(p AS BIGINT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(x.d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x.d)), lambda i: CASE WHEN i % 2 = 0 THEN ascii(x.d[length(x.d)-i])-48 WHEN ascii(x.d[length(x.d)-i])-48 > 4 THEN 2*(ascii(x.d[length(x.d)-i])-48)-9 ELSE 2*(ascii(x.d[length(x.d)-i])-48) END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(x.d) BETWEEN 9 AND 15"),
    ("iban", "__IBAN__", "list_reduce(list_transform(list_filter(string_split(replace(x.v, ' ', '')[5:] || replace(x.v, ' ', '')[1:4], ''), lambda c: c <> ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(x.v, '^(000|666|9..)|-00-|-0000$') AND regexp_matches(x.c, '\\b(ssn|social security)') AND NOT regexp_matches(x.c, '\\b(order|serial|part)')"),
    ("access_key", r"\bAKIA[A-Z0-9]{16}\b", "true"),
    ("secret", r"\b(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}", "true"),
)


def _pii() -> str:
    parts = []
    for k, (name, pattern, good) in enumerate(_KINDS):
        p = pattern.replace("'", "''").replace("__IBAN__", "\\b(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")\\b")
        parts.append(f"""SELECT doc_id, {k} AS k, '{name}' AS kind, x.s, x.e FROM (SELECT doc_id, unnest(list_transform(range(1, len(m)+1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0),
          'e': list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))), 'v': m[i], 'd': regexp_replace(m[i], '[^0-9]', '', 'g'),
          'c': lower(right(list_aggregate(list_transform(range(1, i+1), lambda j: g[j] || CASE WHEN j < i THEN m[j] ELSE '' END), 'string_agg', ''), 40) || ' ' || left(list_aggregate(list_transform(range(i+1, len(g)+1), lambda j: g[j] || coalesce(m[j], '')), 'string_agg', ''), 40))}})) AS x
          FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d) y WHERE len(m) > 0) z WHERE {good}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
      , s AS (SELECT doc_id, string_agg(kind||':'||CAST(s AS BIGINT)||':'||CAST(e AS BIGINT), ',' ORDER BY s, k) AS every, string_agg(kind||':'||CAST(s AS BIGINT)||':'||CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < 4) AS base,
          count(*) FILTER (k=0) AS a, count(*) FILTER (k=1) AS b, count(*) FILTER (k=2) AS c, count(*) FILTER (k=3) AS p FROM f GROUP BY doc_id)
      SELECT d.doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""


# Own expressions for the sentences that single words settle; texts of several sentences (BSD, MIT grants) are left to the tests.
OP5 = r"""WITH a AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1'||chr(1), 'g'), '\n\s*([A-Z(\n])', chr(1)||'\1', 'g'), chr(1)) AS l FROM documents)
, b AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, lower(unnest(l)) AS s FROM a)
, c AS (SELECT doc_id, i, replace(s, 'licence', 'license') AS s FROM b
    WHERE contains(s, 'licens') OR contains(s, 'licenc') OR contains(s, 'copyright') OR contains(s, 'permission') OR contains(s, 'permitted') OR contains(s, 'redistribut') OR contains(s, 'warrant') OR contains(s, 'spdx')
    OR contains(s, 'public domain') OR contains(s, 'all rights reserved') OR contains(s, 'free software') OR contains(s, 'general public') OR contains(s, 'liab') OR contains(s, 'merchantab') OR contains(s, 'creative commons')
    OR contains(s, 'no rights reserved') OR contains(s, 'unencumbered') OR regexp_matches(s, '\bcc[ -]?(by|0)\b|\b[al]?gpl|\bwtfpl\b'))
, d AS (SELECT doc_id, i, s, CASE WHEN regexp_matches(s, 'apache license') THEN 'Apache' WHEN regexp_matches(s, 'affero general public license') THEN 'Agpl' WHEN regexp_matches(s, '(lesser|library) general public license') THEN 'Lgpl'
    WHEN regexp_matches(s, 'gnu general public license') THEN 'Gpl' WHEN regexp_matches(s, 'cc[ -]by-nc-sa') THEN 'CcByNcSa' WHEN regexp_matches(s, 'cc[ -]by-nc-nd') THEN 'CcByNcNd' WHEN regexp_matches(s, 'cc[ -]by-nc') THEN 'CcByNc'
    WHEN regexp_matches(s, 'cc[ -]by-sa') THEN 'CcBySa' WHEN regexp_matches(s, 'cc[ -]by-nd') THEN 'CcByNd' WHEN regexp_matches(s, '\bcc[ -]by') THEN 'CcBy' WHEN regexp_matches(s, '\bcc0\b') THEN 'Cc0'
    WHEN regexp_matches(s, '(under|the) mit license') THEN 'Mit' WHEN regexp_matches(s, 'under the bsd license') THEN 'Bsd' WHEN regexp_matches(s, '(in|into|to) the public domain') THEN 'PublicDomain'
    WHEN contains(s, 'all rights reserved') THEN 'AllRights' WHEN regexp_matches(s, 'copyright (\(c\) )?[0-9]{4}') THEN 'Copyright' ELSE 'Unknown' END AS kind FROM c)
, e AS (SELECT *, CASE WHEN kind IN ('Apache', 'Agpl', 'Lgpl', 'Gpl') THEN regexp_extract(s, '(version |license,? v?)([0-9](\.[0-9])?)', 2) WHEN kind LIKE 'CcBy%' THEN regexp_extract(s, 'cc[ -]by[a-z-]* ([0-9]\.[0-9])', 1) ELSE '' END AS v FROM d)
, f AS (SELECT *, CASE WHEN length(v) = 1 THEN v || '.0' ELSE v END AS w FROM e)
, g AS (SELECT doc_id, string_agg(kind || w, ',' ORDER BY i) AS sequence, count(*) FILTER (kind = 'Unknown') AS n_unknown FROM f GROUP BY doc_id)
, n AS (SELECT doc_id, o, name || CASE WHEN w = '' THEN '' ELSE '-' || w END AS name FROM f JOIN (VALUES ('Apache', 'Apache', 1), ('Agpl', 'AGPL', 2), ('Lgpl', 'LGPL', 3), ('Gpl', 'GPL', 4), ('CcByNcSa', 'CC-BY-NC-SA', 5), ('CcByNcNd', 'CC-BY-NC-ND', 6),
    ('CcByNc', 'CC-BY-NC', 7), ('CcBySa', 'CC-BY-SA', 8), ('CcByNd', 'CC-BY-ND', 9), ('CcBy', 'CC-BY', 10), ('Cc0', 'CC0-1.0', 11), ('Mit', 'MIT', 12), ('Bsd', 'BSD', 13), ('PublicDomain', 'Public-Domain', 14), ('AllRights', 'Proprietary', 15)) x(kind, name, o) USING (kind))
, h AS (SELECT doc_id, string_agg(name, ',' ORDER BY o, name) AS licenses FROM (SELECT doc_id, name, min(o) AS o FROM n GROUP BY doc_id, name) y GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(sequence, '') AS sequence, coalesce(n_unknown, 0) AS n_unknown FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format(t="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents)
, s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a)-1), lambda i: a[i]||' '||a[i+1]||' '||a[i+2]) END) AS g FROM w)
, n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id)
, p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)
, l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100*i >= 90*(na.n + nb.n - i)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
, r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n"""

# Rests on the parts around the text, not on the element that holds it.
OP9 = r"""WITH a AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<!.*?>', ' ', 'g') AS h FROM pages)
, t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a)
, u AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM u"""

SQL: dict[str, str] = {"op3_exact_dedup": OP3, "op4_pii": _pii(), "op5_license_scan": OP5, "op7_jaccard_join": OP7, "op9_html_extraction": OP9}
