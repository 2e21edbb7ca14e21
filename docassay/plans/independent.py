"""Comparison SQL written from the rules of the operators, by other ways than the operators go."""

from __future__ import annotations

from ..operators.timestamps import MONTHS
from ..operators.units import UNITS
from .portable import filled

_MONTHS = ", ".join(f"('{name}', {number})" for number, names in MONTHS.items() for name in names.split())
# Abbreviations of zones with their offsets in hours.
_ZONES = "('Asia/Jakarta', 'WIB', 7), ('America/Chicago', 'CST', -6), ('America/Chicago', 'CDT', -5), ('Europe/London', 'BST', 1), ('Europe/London', 'GMT', 0), ('Europe/Amsterdam', 'CET', 1), ('Europe/Amsterdam', 'CEST', 2), ('Australia/Sydney', 'AEST', 10), ('Australia/Sydney', 'AEDT', 11), ('Asia/Singapore', 'SGT', 8), ('Asia/Tokyo', 'JST', 9), ('Asia/Kolkata', 'IST', 5.5), ('America/Denver', 'MST', -7), ('America/Denver', 'MDT', -6)"
_TIME = r"(?:T|\s)\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?$"

# Boxes by walking down each record one level at a time; strings that hold JSON are read in a step of their own.
P4 = """
WITH RECURSIVE once AS (SELECT issue_id, any_value(evidence) AS evidence FROM issues GROUP BY issue_id),
n(issue_id, path, j) AS (
  SELECT issue_id, '', evidence::JSON FROM once WHERE json_valid(evidence)
  UNION ALL
  SELECT n.issue_id, CASE WHEN e.k = 'INSIDE' THEN n.path WHEN e.k = 'ARRAY' THEN n.path || '[' || e.name || ']' WHEN n.path = '' THEN e.name ELSE n.path || '.' || e.name END, e.v
  FROM n, LATERAL (
    SELECT 'OBJECT' AS k, name, json_extract(n.j, '$."' || name || '"') AS v FROM (SELECT unnest(CASE WHEN json_type(n.j) = 'OBJECT' THEN json_keys(n.j) ELSE [] END) AS name) a
    UNION ALL SELECT 'ARRAY', CAST(i AS VARCHAR), json_extract(n.j, '$[' || i || ']') FROM (SELECT unnest(range(CAST(coalesce(json_array_length(n.j), 0) AS BIGINT))) AS i) b
    UNION ALL SELECT 'INSIDE', NULL, json_extract_string(n.j, '$')::JSON FROM (SELECT 1) c WHERE json_type(n.j) = 'VARCHAR' AND CASE WHEN json_valid(json_extract_string(n.j, '$')) THEN json_type(json_extract_string(n.j, '$')::JSON) IN ('OBJECT', 'ARRAY', 'VARCHAR') ELSE false END
  ) e)
SELECT DISTINCT issue_id, path AS box_path FROM n WHERE json_type(j) = 'OBJECT' AND list_has_all(json_keys(j), ['x0', 'y0', 'x1', 'y1'])"""

# Tables of nested records: nodes by walking down as above, with labels, then the nodes that have a row and the members they have.
_HOLDS = "json_type(n.j) = 'VARCHAR' AND CASE WHEN json_valid(json_extract_string(n.j, '$')) THEN json_type(json_extract_string(n.j, '$')::JSON) IN ('OBJECT', 'ARRAY') OR json_type(json_extract_string(n.j, '$')::JSON) = 'VARCHAR' AND regexp_matches(json_extract_string(json_extract_string(n.j, '$')::JSON, '$'), '^\\s*[{[]') ELSE false END"
TABLES_SQL = f"""
WITH RECURSIVE once AS (SELECT issue_id, any_value(evidence) AS evidence FROM issues GROUP BY issue_id),
n(issue_id, dewey, parent_dewey, ordinal, depth, path, schema, name, pk, owner_dewey, owner_table, oname, j) AS (
  SELECT issue_id, '', CAST(NULL AS VARCHAR), CAST(NULL AS INT), 0, '', '', CAST(NULL AS VARCHAR), 'ROOT', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), evidence::JSON FROM once WHERE json_valid(evidence)
  UNION ALL
  SELECT n.issue_id,
    CASE e.k WHEN 'INSIDE' THEN n.dewey ELSE CASE WHEN n.dewey = '' THEN '' ELSE n.dewey || '.' END || e.i END,
    CASE e.k WHEN 'INSIDE' THEN n.parent_dewey ELSE n.dewey END, CASE e.k WHEN 'INSIDE' THEN n.ordinal ELSE e.i END, CASE e.k WHEN 'INSIDE' THEN n.depth ELSE n.depth + 1 END,
    CASE e.k WHEN 'INSIDE' THEN n.path WHEN 'ARRAY' THEN n.path || '[' || e.i || ']' ELSE CASE WHEN n.path = '' THEN '' ELSE n.path || '.' END || e.name END,
    CASE e.k WHEN 'INSIDE' THEN n.schema WHEN 'ARRAY' THEN n.schema || '[]' ELSE CASE WHEN n.schema = '' THEN '' ELSE n.schema || '.' END || e.name END,
    CASE e.k WHEN 'INSIDE' THEN n.name WHEN 'OBJECT' THEN e.name END, CASE e.k WHEN 'INSIDE' THEN n.pk ELSE e.k END,
    CASE WHEN e.k = 'INSIDE' OR e.k = 'ARRAY' AND n.pk = 'OBJECT' THEN n.owner_dewey ELSE n.dewey END,
    CASE WHEN e.k = 'INSIDE' OR e.k = 'ARRAY' AND n.pk = 'OBJECT' THEN n.owner_table WHEN n.schema = '' THEN 'root' ELSE n.schema END,
    CASE WHEN e.k = 'INSIDE' THEN n.oname WHEN e.k = 'ARRAY' AND n.pk = 'OBJECT' THEN n.name WHEN e.k = 'OBJECT' THEN e.name END, e.v
  FROM n, LATERAL (
    SELECT 'OBJECT' AS k, json_keys(n.j)[i + 1] AS name, CAST(i AS INT) AS i, json_extract(n.j, '$."' || json_keys(n.j)[i + 1] || '"') AS v FROM (SELECT unnest(range(CASE WHEN json_type(n.j) = 'OBJECT' THEN len(json_keys(n.j)) ELSE 0 END)) AS i) a
    UNION ALL SELECT 'ARRAY', NULL, CAST(i AS INT), json_extract(n.j, '$[' || i || ']') FROM (SELECT unnest(range(CAST(coalesce(json_array_length(n.j), 0) AS BIGINT))) AS i) b
    UNION ALL SELECT 'INSIDE', NULL, 0, json_extract_string(n.j, '$')::JSON FROM (SELECT 1) c WHERE {_HOLDS}
  ) e),
k AS (SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
    CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(j, '$') END AS value FROM n WHERE NOT ({_HOLDS})),
m AS (SELECT issue_id, parent_dewey AS dewey, '{{' || string_agg(to_json(name) || ':' || coalesce(CAST(to_json(value) AS VARCHAR), 'null'), ',' ORDER BY name) || '}}' AS members, '{{' || string_agg(to_json(name) || ':' || to_json(kind), ',' ORDER BY name) || '}}' AS member_kinds
  FROM k WHERE pk = 'OBJECT' AND kind <> 'object' AND (kind <> 'array' OR json_array_length(j) = 0) GROUP BY ALL)
SELECT CASE WHEN k.schema = '' THEN 'root' ELSE k.schema END AS table_name, k.issue_id, k.dewey, k.parent_dewey, k.ordinal, k.depth, k.path, m.members, k.owner_dewey, k.owner_table, k.oname AS name, k.kind, k.value, m.member_kinds
FROM k LEFT JOIN m ON m.issue_id = k.issue_id AND m.dewey = k.dewey AND k.kind = 'object' WHERE k.kind = 'object' OR k.pk IN ('ARRAY', 'ROOT')"""

# Dates: the time is cut off first, then the day is read; wall-clock times are tried with the offsets of the days around
# them, and an instant counts if its wall clock shows the time.
P7_ALL = rf"""
WITH once AS (SELECT doc_id, any_value(site) AS site, any_value(cover_metadata.document_date) AS document_date, any_value(cover_date) AS cover_date, any_value(creation_date) AS creation_date FROM doc_metadata GROUP BY doc_id),
long AS (SELECT doc_id, site, 'document_date' AS field, document_date AS text FROM once UNION ALL SELECT doc_id, site, 'cover_date', cover_date FROM once UNION ALL SELECT doc_id, site, 'creation_date', creation_date FROM once),
t0 AS (SELECT l.doc_id, l.field, s.time_zone, s.day_first, trim(translate(l.text, chr(160) || chr(8239) || chr(12288), '   ')) AS t FROM long l LEFT JOIN sites s ON s.site = l.site WHERE regexp_matches(l.text, '[0-9]')),
t1 AS (SELECT *, CASE
    WHEN regexp_matches(t, '^D:\d{{14}}') THEN regexp_replace(regexp_replace(t, '^D:(\d{{4}})(\d{{2}})(\d{{2}})(\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3 \4:\5:\6'), '([+-]\d{{2}})''?(\d{{2}})''?$', '\1\2')
    WHEN regexp_matches(t, '^D:\d{{8}}$') THEN regexp_replace(t, '^D:(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3')
    WHEN regexp_matches(t, '^\d{{8}}$') THEN regexp_replace(t, '^(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3')
    WHEN regexp_matches(t, '^\d{{8}}T\d{{6}}(Z|[+-]\d{{4}})?$') THEN regexp_replace(t, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3 \4:\5:\6')
    WHEN regexp_matches(t, '^\d{{8}}T\d{{4}}(Z|[+-]\d{{4}})?$') THEN regexp_replace(t, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})', '\1-\2-\3 \4:\5')
    ELSE t END AS u FROM t0),
t2 AS (SELECT *, regexp_matches(u, '{_TIME}') AS timed, regexp_extract(u, '{_TIME}', ['h', 'mi', 's', 'ap', 'z']) AS c, trim(regexp_replace(u, '{_TIME}', '')) AS d FROM t1),
t3 AS (SELECT *, CASE
    WHEN regexp_matches(d, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}$') THEN regexp_extract(d, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})$', ['y', 'm', 'd'])
    WHEN regexp_matches(d, '^\d{{4}}\s?年\s?\d{{1,2}}\s?月\s?\d{{1,2}}\s?日$') THEN regexp_extract(d, '^(\d{{4}})\s?年\s?(\d{{1,2}})\s?月\s?(\d{{1,2}})\s?日$', ['y', 'm', 'd'])
    WHEN regexp_matches(d, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.](\d{{4}}|\d{{2}})$') THEN CASE WHEN day_first THEN regexp_extract(d, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d+)$', ['d', 'm', 'y']) WHEN NOT day_first THEN regexp_extract(d, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d+)$', ['m', 'd', 'y']) END
    WHEN regexp_matches(d, '^(\p{{L}}+\.?,\s*)?\d{{1,2}}(\.|st|nd|rd|th)?[- ]\s?(de )?\p{{L}}+\.?[- ,]\s?(de )?(\d{{4}}|\d{{2}})$') THEN regexp_extract(d, '(\d{{1,2}})(?:\.|st|nd|rd|th)?[- ]\s?(?:de )?(\p{{L}}+)\.?[- ,]\s?(?:de )?(\d+)$', ['d', 'm', 'y'])
    WHEN regexp_matches(d, '^(\p{{L}}+\.?,\s*)?\p{{L}}+\.? \d{{1,2}}(st|nd|rd|th)?,? \d{{4}}$') THEN regexp_extract(d, '(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$', ['m', 'd', 'y']) END AS p FROM t2),
months(name, number) AS (VALUES {_MONTHS}),
zones(zone, abbreviation, hours) AS (VALUES {_ZONES}),
t4 AS (SELECT t3.*, coalesce(try_cast(p.m AS INT), months.number) AS mo, try_cast(CASE WHEN length(p.y) = 2 THEN '20' || p.y ELSE p.y END AS INT) AS y, try_cast(p.d AS INT) AS dd,
    try_cast(c.h AS INT) AS h, try_cast(c.mi AS INT) AS mi, coalesce(try_cast(nullif(c.s, '') AS INT), 0) AS s, lower(replace(c.ap, '.', '')) AS ap FROM t3 LEFT JOIN months ON months.name = lower(p.m)),
t5 AS (SELECT *, CASE WHEN ap = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE ap WHEN 'pm' THEN 12 ELSE 0 END END AS hh, try_strptime(printf('%04d-%02d-%02d', y, mo, dd), '%Y-%m-%d') AS day FROM t4),
t6 AS (SELECT t5.doc_id, field, time_zone, timed, day, c.z AS z, CASE WHEN timed AND hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN day + to_seconds(hh * 3600 + mi * 60 + s) END AS wall,
    CASE WHEN regexp_matches(t, '^\d{{10}}$') THEN try_cast(t AS BIGINT) WHEN regexp_matches(t, '^\d{{13}}$') THEN try_cast(t AS BIGINT) // 1000 END AS epoch,
    CASE WHEN upper(c.z) IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_matches(c.z, '^[+-]') THEN try_cast(c.z[1] || '1' AS INT) * (try_cast(c.z[2:3] AS INT) * 3600 + coalesce(try_cast(nullif(replace(c.z[4:], ':', ''), '') AS INT), 0) * 60) ELSE CAST(zones.hours * 3600 AS BIGINT) END AS stated
  FROM t5 LEFT JOIN zones ON zones.zone = time_zone AND zones.abbreviation = upper(c.z)),
t7 AS (SELECT *, epoch_us(wall) // 1000000 AS w, epoch_us(timezone(time_zone, (wall - INTERVAL 1 DAY))) // 1000000 - epoch_us(wall - INTERVAL 1 DAY) // 1000000 AS east1, epoch_us(timezone(time_zone, (wall + INTERVAL 1 DAY))) // 1000000 - epoch_us(wall + INTERVAL 1 DAY) // 1000000 AS east2 FROM t6),
t8 AS (SELECT *, [x FOR x IN list_distinct([w + east1, w + east2]) IF epoch_us(timezone(time_zone, make_timestamptz(x * 1000000))) // 1000000 = w] AS hits FROM t7),
t9 AS (SELECT doc_id, field,
    CASE WHEN epoch IS NOT NULL THEN strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN NOT timed THEN strftime(day, '%Y-%m-%d') WHEN stated IS NOT NULL THEN strftime(wall - to_seconds(stated), '%Y-%m-%dT%H:%M:%SZ')
      WHEN z = '' THEN strftime(make_timestamp(coalesce(list_min(hits), w + east1) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso,
    CASE WHEN epoch IS NOT NULL THEN 'EPOCH' WHEN NOT timed THEN 'DAY' WHEN stated IS NOT NULL THEN 'ZONED' WHEN len(hits) = 0 THEN 'NONEXISTENT' WHEN len(hits) = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status FROM t8)
"""

_ITEMS = "(SELECT item_id, doc_id, seq, text, page_index, x0, y0, true AS heading FROM {HEADINGS} h UNION ALL SELECT item_id, doc_id, seq, text, page_index, x0, y0, false FROM {SPANS} s)"

# Roman numerals from left to right: a sign before a larger one counts negative.
ROMAN = r"""
WITH p AS (SELECT page_id, trim(page_number) AS t FROM {PAGES} x WHERE page_number IS NOT NULL),
v AS (SELECT page_id, t, regexp_matches(t, '^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$', 'i') AND t <> '' AS strict, list_transform(string_split(lower(t), ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END) AS n FROM p)
SELECT page_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN TRY_CAST(t AS INT) WHEN strict THEN CAST(list_sum(list_transform(n, lambda x, i: CASE WHEN x < coalesce(n[i + 1], 0) THEN -x ELSE x END)) AS INT) END AS value FROM v"""

# Numbers of cells: sign, currency and unit are cut off one after the other, then the marks are read.
_UNIT = r"(?:%|°[CF]|K|MPa|kPa|GPa|psi|ksi|bar|mbar|kN|N|lbf|kgf|mm|cm|m|in|ft|kg|g|mg|t|tonne|ton|lbs?|oz|kJ|J|ft-lbs?|sec|s|min|hrs?|h|pcs|ea|qty|nos|items?)"
DECIMALS = rf"""
WITH a AS (SELECT cell_id, trim(translate(text, '０１２３４５６７８９．，－＋％（）' || chr(160) || chr(12288) || chr(8239) || chr(8201) || chr(8199), '0123456789.,-+%()     ')) AS t FROM {{CELLS}} c WHERE text IS NOT NULL),
b AS (SELECT *, regexp_matches(t, '^\(.*\)$') AS br, CASE WHEN regexp_matches(t, '^\(.*\)$') THEN trim(t[2:-2]) ELSE trim(regexp_replace(t, '^[-+]', '')) END AS u FROM a),
c AS (SELECT *, br OR t LIKE '-%' AS neg, regexp_extract(u, '^([$€£¥]|(?i:Rp\.?|IDR|USD|EUR))\s*', 1) AS cur, trim(regexp_replace(u, '^([$€£¥]|(?i:Rp\.?|IDR|USD|EUR))\s*', '')) AS w FROM b),
d AS (SELECT *, regexp_extract(w, '(?i)\s*({_UNIT})$', 1) AS suf, regexp_replace(trim(regexp_replace(w, '(?i)\s*({_UNIT})$', '')), '([0-9])\s+([0-9])', '\1\2', 'g') AS n0 FROM c),
e AS (SELECT *, regexp_replace(n0, '([0-9])\s+([0-9])', '\1\2', 'g') AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(n, '^[0-9][0-9,.]*$') THEN NULL
    WHEN n LIKE '%,%' AND n LIKE '%.%' THEN CASE WHEN strpos(reverse(n), ',') > strpos(reverse(n), '.') THEN replace(n, ',', '') ELSE replace(replace(n, '.', ''), ',', '.') END
    WHEN n LIKE '%,%' AND (len(string_split(n, ',')) > 2 OR regexp_matches(n, ',[0-9]{{3}}$')) THEN replace(n, ',', '') WHEN n LIKE '%,%' THEN replace(n, ',', '.')
    WHEN len(string_split(n, '.')) > 2 THEN replace(n, '.', '') ELSE n END AS plain FROM e),
g AS (SELECT cell_id, CASE WHEN neg THEN -1 ELSE 1 END * TRY_CAST(plain AS DECIMAL(28, 10)) AS value, lower(trim(CASE WHEN trim(cur) <> '' THEN cur ELSE suf END)) AS ul, trim(CASE WHEN trim(cur) <> '' THEN cur ELSE suf END) AS uo FROM f)
SELECT cell_id, CAST(value AS DOUBLE) AS value, CASE WHEN uo = '' THEN NULL WHEN ul IN ('lbs', 'lb') THEN 'lb' WHEN ul IN ('ft-lbs', 'ft-lb') THEN 'ft-lb' WHEN ul IN ('hrs', 'hr', 'h') THEN 'hr' WHEN ul IN ('sec', 's') THEN 's' WHEN ul IN ('mins', 'min') THEN 'min' WHEN ul IN ('pcs', 'items', 'ea', 'nos', 'qty') THEN ul
    WHEN ul IN ('usd', '$') THEN '$' WHEN ul IN ('eur', '€') THEN '€' WHEN ul IN ('gbp', '£') THEN '£' ELSE uo END AS unit FROM g WHERE value IS NOT NULL"""

ENTITIES = r"""
WITH p AS (SELECT page_id, doc_id, page_index, [coalesce(header_text, ''), coalesce(footer_text, ''), coalesce(raw_text, '')] AS parts FROM {PAGES} x),
n AS (SELECT *, list_filter(list_transform(parts, lambda t: regexp_extract(t, '(?:^|[^\p{L}\p{M}\p{N}_])(page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+\s*/\s*[0-9]+|[ivxlcdm]+)(?:$|[^\p{L}\p{M}\p{N}_])', 1, 'i')), lambda t: t <> '') AS l,
  list_filter(list_transform(parts, lambda t: regexp_extract(t, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Z0-9]{2,}-[A-Z0-9\-_/]{4,}|DOC(?:NO)?[:\s#]+[A-Z0-9\-_/]+)(?:$|[^\p{L}\p{M}\p{N}_])', 1, 'i')), lambda t: t <> '') AS d FROM p)
SELECT page_id, doc_id, page_index, l[1] AS page_label, d[1] AS doc_number FROM n"""

_SINGLE = ["location", "bounding_box", "total_location", "entry_location", "target_location", "body_location", "bibliography_location", "original_location"]
_BOXES = " UNION ALL ".join([f"SELECT issue_id, {i} AS o, 0 AS i, '{k}' AS source, json_extract(j, '$.{k}') AS b FROM e" for i, k in enumerate(_SINGLE)] + [f"SELECT issue_id, {10 + i}, i, '{k}', CASE WHEN json_type(j, '$.{k}') = 'OBJECT' THEN json_extract(j, '$.{k}') ELSE json_extract(j, '$.{k}[' || i || ']') END FROM (SELECT *, unnest(range(CAST(CASE WHEN json_type(j, '$.{k}') = 'OBJECT' THEN 1 ELSE coalesce(json_array_length(j, '$.{k}'), 0) END AS BIGINT))) AS i FROM e) u" for i, k in enumerate(("locations", "operand_locations"))])
EVIDENCE = f"""
WITH e AS (SELECT issue_id, CASE WHEN json_valid(evidence) THEN evidence::JSON END AS j FROM {{ISSUES}} i),
b AS ({_BOXES}),
n AS (SELECT issue_id, o, i, source, TRY_CAST(b->>'page_index' AS INT) AS page_index, {', '.join(f"TRY_CAST(b->>'{c}' AS DOUBLE) AS {c}" for c in ('x0', 'y0', 'x1', 'y1', 'page_width', 'page_height'))} FROM b WHERE json_type(b) = 'OBJECT')
SELECT issue_id, row_number() OVER (PARTITION BY issue_id ORDER BY o, i) - 1 AS pos, source, page_index, x0, y0, x1, y1, page_width, page_height FROM n WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL"""

BREAKS = rf"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, seq, item_id) AS up, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0 DESC, x0 DESC, seq DESC, item_id DESC) AS down FROM {_ITEMS} i
  WHERE trim(text) <> '' AND NOT regexp_matches(text, '^\s*(?:page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+|[ivxlcdm]+|[A-Z0-9\-_/]{{6,}})\s*$', 'i')),
l AS (SELECT doc_id, page_index, item_id, trim(text) AS t FROM b WHERE down = 1), f AS (SELECT doc_id, page_index, item_id, trim(text) AS t FROM b WHERE up = 1),
p AS (SELECT l.doc_id, l.page_index, l.item_id AS last_item, l.t AS a, (SELECT min(f.page_index) FROM f WHERE f.doc_id = l.doc_id AND f.page_index > l.page_index) AS next_page FROM l),
q AS (SELECT p.*, f.item_id AS first_item, f.t AS b, CASE WHEN regexp_matches(a, '\b(and|or|but|nor|so|yet|with|as|to|for|of|in|on|at|by|from|the|a|an)\s*$', 'i') THEN 'conjunction' WHEN regexp_matches(a, '[,;–—-]\s*$') THEN 'punctuation'
    WHEN NOT regexp_matches(a, '[.!?:]\s*[''")\]]*$') AND (regexp_matches(f.t, '^\p{{Ll}}') OR regexp_matches(f.t, '^(and|or|but|which|that|with|as|to|for)\b', 'i')) THEN 'continues' END AS reason FROM p JOIN f ON f.doc_id = p.doc_id AND f.page_index = p.next_page)
SELECT doc_id, page_index, next_page, last_item, first_item, reason FROM q WHERE reason IS NOT NULL"""

# Every entry against every target of its document.
_TITLE = r"regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '^[0-9.]+\s+', ''))), '[.\s_–—]+$', ''), '\s+', ' ', 'g')"
_NUMBER = r"^(?:(?:figure|fig\.?|table|section)\s+)?([0-9]+(?:\.[0-9]+)*\b)"
DRIFT = rf"""
WITH e AS (SELECT doc_id, item_id, {_TITLE} AS title, page_index + 1 AS label FROM {{HEADINGS}} h WHERE level = 1 AND text IS NOT NULL),
t AS (SELECT doc_id, seq, {_TITLE} AS title, page_index + 1 AS label FROM {{HEADINGS}} h WHERE level = 2 AND text IS NOT NULL),
m AS (SELECT e.doc_id, e.item_id, t.seq, t.label, CASE WHEN e.title = t.title THEN 1 WHEN starts_with(e.title, t.title) OR starts_with(t.title, e.title) THEN 2 ELSE 3 END AS tier FROM e JOIN t ON t.doc_id = e.doc_id AND (starts_with(e.title, t.title) OR starts_with(t.title, e.title)
    OR regexp_extract(e.title, '{_NUMBER}', 1) <> '' AND regexp_extract(e.title, '{_NUMBER}', 1) = regexp_extract(t.title, '{_NUMBER}', 1))),
k AS (SELECT *, min(tier) OVER (PARTITION BY doc_id, item_id) AS best FROM m),
g AS (SELECT doc_id, item_id, tier, arg_min(label, seq) AS target, count(DISTINCT label) AS matches FROM k WHERE tier = best GROUP BY ALL),
r AS (SELECT e.doc_id, e.item_id, e.title, CAST(e.label AS VARCHAR) AS label, CAST(g.target AS VARCHAR) AS target_label, g.tier, coalesce(g.matches, 0) AS matches, coalesce(g.target - e.label, 0) AS delta FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.item_id = e.item_id),
z AS (SELECT *, CASE WHEN tier IS NULL THEN 'TARGET_NOT_FOUND' WHEN matches > 1 THEN 'DUPLICATE_TARGET' WHEN delta <> 0 THEN 'PAGE_DRIFT' ELSE 'OK' END AS kind FROM r)
SELECT * FROM z"""

# Citations: all families in one list of patterns that every text is tried with.
_YEAR = r"(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b"
_FAMILIES = {
    "ASME": r"\b(ASME\s+(?:(?:SEC(?:TION)?\.?)\s*)?[IVXLCDM]+(?:\s+(?:DIV(?:ISION)?\.?)\s*[0-9]+)?)", "API": r"\b(API\s+(?:(?:STD|SPEC|RP)\s+)?[0-9]{1,4}[A-Z]?)",
    "ASTM": r"\b(ASTM\s+[A-Z][0-9]{1,4}(?:/[A-Z][0-9]{1,4})?M?)", "ISO": r"\b((?:EN\s+)?ISO\s+[0-9]{3,6}(?:-[0-9]+)?)", "SITE": r"\b((?:QN|MPC|TRS)\s+[0-9]{1,4})",
}
_EACH = " UNION ALL ".join(f"SELECT i.*, '{k}' AS family, unnest(regexp_extract_all(text, '{p}{_YEAR}', 0, 'i')) AS hit, '{p}{_YEAR}' AS pattern FROM i" for k, p in _FAMILIES.items())
CITED = rf"""
WITH i AS (SELECT * FROM {_ITEMS} u WHERE text IS NOT NULL),
s AS (SELECT doc_id, min(struct_pack(a := page_index, b := y0, c := x0, d := seq, e := item_id)) AS first FROM i WHERE regexp_matches(trim(text), '^(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:NORMATIVE\s+)?(?:REFERENCES?|BIBLIOGRAPHY|CODES?\s+AND\s+STANDARDS?)$', 'i') AND (heading OR length(text) <= 80) GROUP BY doc_id),
h AS ({_EACH}),
n AS (SELECT h.doc_id, item_id, page_index, y0, x0, family, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(regexp_extract(hit, pattern, 1, 'i'))), '[.,]$', ''), '\s+', ' ', 'g'), '\bSEC(?:TION)?\.?\s*', 'SECTION ', 'g'), '\bDIV(?:ISION)?\.?\s*', 'DIVISION ', 'g'), '^EN ISO ', 'ISO ') AS code,
    TRY_CAST(nullif(regexp_extract(hit, pattern, 2, 'i'), '') AS INT) AS year, CASE WHEN struct_pack(a := page_index, b := y0, c := x0, d := seq, e := item_id) >= s.first THEN 'REFERENCE' ELSE 'BODY' END AS section FROM h LEFT JOIN s ON s.doc_id = h.doc_id),
c AS (SELECT *, family = 'API' AND regexp_matches(code, '^API [0-9]+[A-Z]?$') AND code[5:] NOT IN ('510', '570', '579', '650', '653', '1104', '5L', '6A') AS ambiguous FROM n)
"""
TRACED = CITED + """SELECT doc_id, kind, code, year, count(*) AS citations FROM (
  SELECT b.doc_id, b.code, b.year, CASE WHEN b.ambiguous THEN 'AMBIGUOUS_CITATION' WHEN r.years IS NULL THEN 'STANDARD_NOT_IN_BIBLIOGRAPHY' WHEN b.year IS NOT NULL AND len(r.years) > 0 AND NOT list_contains(r.years, b.year) THEN 'EDITION_YEAR_MISMATCH' END AS kind
  FROM c b LEFT JOIN (SELECT doc_id, code, list(DISTINCT year) FILTER (WHERE year IS NOT NULL) AS years0, coalesce(list(DISTINCT year) FILTER (WHERE year IS NOT NULL), []) AS years FROM c WHERE section = 'REFERENCE' GROUP BY doc_id, code) r ON r.doc_id = b.doc_id AND r.code = b.code
  WHERE b.section = 'BODY') t WHERE kind IS NOT NULL GROUP BY ALL"""

# Quantities: headers, unit rows and titles are joined to the columns they stand over; pairs are compared with each other directly.
_ALIASES = ", ".join(f"('{d}', '{a}', CAST({f!r} AS DOUBLE), CAST({o!r} AS DOUBLE))" for d, f, o, names in UNITS for a in names)
_M, _E = r"[-+−]?[0-9](?:[0-9.,'' ]*[0-9])?", r"\s*[eE][-+]?[0-9]+|\s*[x×]\s*10\^?[-−]?[0-9]+"
_FEET = r"^([0-9]+)\s*(?:''|ft|feet)\s*-?\s*([0-9]+)?\s*(?:([0-9]+)/([0-9]+))?\s*(?:\"|in|inch)$"
_BEHIND, _AHEAD = rf"^[(]?({_M})({_E})?[)]?\s*([^0-9\s.,'')].*)?$", rf"^([^0-9\s(+−-].*?)\s+({_M})({_E})?$"
_SCALED = r"^(?:(?i)(x ?[0-9]+|10\^[0-9]+|hundred|thousand|million)\s+)?(\S.*)$"


def _unit_key(text: str) -> str:
    return rf"lower(regexp_replace(replace(replace(translate({text}, '²³µμ', '23uu'), '℃', '°C'), '℉', '°F'), '\s+', ' ', 'g'))"


QUANTITIES = rf"""
WITH alias(dimension, alias, factor, shift) AS (VALUES {_ALIASES}),
target AS (SELECT quantity, lower(quantity) AS q, common_unit, dimension, factor AS tf, shift AS ts FROM unit_targets JOIN alias ON alias = {_unit_key('common_unit')}),
plain AS (SELECT cell_id, doc_id, table_index, row_index, greatest(coalesce(row_span, 1), 1) AS rs, col_index, trim(translate(text, chr(160) || chr(8239) || chr(8201) || chr(8199), '    ')) AS t FROM {{CELLS}} x WHERE text IS NOT NULL),
head AS (SELECT p.*, target.*, regexp_replace(regexp_replace(substr(regexp_replace(t, '\s+', ' ', 'g'), length(q) + 1), '^[\s,/:(\[-]*', ''), '[\s)\]]*$', '') AS said FROM plain p JOIN target ON regexp_matches(lower(regexp_replace(t, '\s+', ' ', 'g')), '^' || q || '([^0-9a-z]|$)') WHERE col_index > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_index, col_index ORDER BY row_index) AS n FROM head),
unit_row AS (SELECT doc_id, table_index, col_index, min(t) AS u FROM plain p JOIN alias ON alias = {_unit_key(f"regexp_extract(t, '{_SCALED}', 2)")} WHERE alias <> '1' AND col_index > 0 GROUP BY ALL),
part AS (SELECT doc_id, table_index, unnest(string_split(t, ';')) AS x FROM plain WHERE t LIKE '%;% in %'),
title AS (SELECT doc_id, table_index, lower(regexp_extract(x, '^\s*(.+?)\s+in\s+(.+?)\s*$', 1)) AS q, min(regexp_extract(x, '^\s*(.+?)\s+in\s+(.+?)\s*$', 2)) AS u FROM part WHERE regexp_matches(x, '^\s*.+?\s+in\s+.+') GROUP BY ALL),
col AS (SELECT h.doc_id, h.table_index, h.col_index, h.quantity, h.common_unit, h.dimension, h.tf, h.ts, coalesce(nullif(h.said, ''), r.u, t.u) AS around FROM top h LEFT JOIN unit_row r USING (doc_id, table_index, col_index) LEFT JOIN title t ON t.doc_id = h.doc_id AND t.table_index = h.table_index AND t.q = h.q WHERE h.n = 1),
tag AS (SELECT doc_id, table_index, unnest(range(row_index, row_index + rs)) AS row_at, t AS tag, row_index FROM plain WHERE col_index = 0 AND t <> ''),
tags AS (SELECT doc_id, table_index, row_at, arg_min(tag, row_index) AS tag FROM tag GROUP BY ALL),
form AS (SELECT *, CASE WHEN regexp_matches(t, '{_FEET}') THEN 'F' WHEN regexp_matches(t, '{_BEHIND}') THEN 'B' WHEN regexp_matches(t, '{_AHEAD}') THEN 'A' END AS k FROM plain WHERE col_index > 0 AND regexp_matches(t, '[0-9]')),
got AS (SELECT *, CASE k WHEN 'B' THEN regexp_extract(t, '{_BEHIND}', ['m', 'e', 'u']) WHEN 'A' THEN regexp_extract(t, '{_AHEAD}', ['u', 'm', 'e']) END AS g, CASE k WHEN 'F' THEN regexp_extract(t, '{_FEET}', ['a', 'b', 'c', 'd']) END AS f FROM form WHERE k IS NOT NULL),
mark AS (SELECT *, regexp_matches(g.m, '['' ]') AS parted, regexp_replace(translate(g.m, '−', '-'), '['' ]', '', 'g') AS m FROM got),
num AS (SELECT doc_id, table_index, row_index, col_index, cell_id, t, CASE WHEN k = 'F' THEN 'ft' ELSE nullif(g.u, '') END AS own,
  CASE WHEN k = 'F' THEN CAST(f.a AS DOUBLE) + (coalesce(TRY_CAST(nullif(f.b, '') AS DOUBLE), 0) + coalesce(TRY_CAST(nullif(f.c, '') AS DOUBLE) / TRY_CAST(nullif(f.d, '') AS DOUBLE), 0)) / 12
  ELSE TRY_CAST(CASE WHEN m LIKE '%,%' AND m LIKE '%.%' THEN CASE WHEN strpos(reverse(m), ',') < strpos(reverse(m), '.') THEN replace(replace(m, '.', ''), ',', '.') ELSE replace(m, ',', '') END
      WHEN m LIKE '%,%,%' OR regexp_matches(m, '^[-+]?[0-9]+,[0-9]{{3}}$') AND NOT parted THEN replace(m, ',', '') WHEN m LIKE '%,%' THEN replace(m, ',', '.') WHEN m LIKE '%.%.%' THEN replace(m, '.', '') ELSE m END AS DOUBLE)
    * CASE WHEN g.e = '' THEN 1 ELSE power(10.0, CAST(regexp_extract(translate(g.e, '−', '-'), '([-+]?[0-9]+)$', 1) AS INT)) END * CASE WHEN regexp_matches(t, '^[(].*[)]') THEN -1 ELSE 1 END END AS number FROM mark),
unit AS (SELECT num.*, col.*, tags.tag, regexp_extract(around, '{_SCALED}', 1) AS word, CASE WHEN own IS NOT NULL THEN own WHEN around IS NOT NULL THEN regexp_extract(around, '{_SCALED}', 2) WHEN dimension = 'ratio' THEN '1' END AS chosen
  FROM num JOIN col USING (doc_id, table_index, col_index) JOIN tags ON tags.doc_id = num.doc_id AND tags.table_index = num.table_index AND tags.row_at = num.row_index WHERE number IS NOT NULL),
valued AS (SELECT unit.*, ((CASE WHEN own IS NOT NULL OR coalesce(word, '') = '' THEN 1 WHEN lower(word) = 'hundred' THEN 100 WHEN lower(word) = 'thousand' THEN 1000 WHEN lower(word) = 'million' THEN 1000000 WHEN word LIKE '10^%' THEN power(10.0, CAST(word[4:] AS DOUBLE)) ELSE coalesce(TRY_CAST(trim(word[2:]) AS DOUBLE), 1) END
    * number * factor + shift) - ts) / tf AS value FROM unit LEFT JOIN alias ON alias.dimension = unit.dimension AND alias.alias = {_unit_key('chosen')})
"""
P1_VALUES = QUANTITIES + """SELECT DISTINCT cell_id, doc_id, table_index, row_index, col_index, tag, quantity, t AS text, number, coalesce(own, around, CASE WHEN dimension = 'ratio' THEN '1' END) AS unit,
  CASE WHEN own IS NOT NULL THEN 'CELL' WHEN around IS NOT NULL THEN 'AROUND' WHEN dimension = 'ratio' THEN 'RATIO' END AS unit_from, value, common_unit FROM valued"""
_LIMIT = r"'[{]limit[}]\s*([^{}]*?)\s*(?:\bof\b|\bor\b|[.,;]|$)'"
P1_FOUND = QUANTITIES + rf""", stated AS (SELECT rule_no, numeric_limit_params.parameter_name AS name, numeric_limit_params.limit_value AS number, target.*, coalesce(nullif(regexp_extract(title, '[(\[]([^()\[\]]+)[)\]]\s*$', 1), ''), nullif(regexp_extract(message_template, {_LIMIT}, 1), ''), nullif(regexp_extract(recommendation_template, {_LIMIT}, 1), ''),
    nullif(replace(regexp_extract(numeric_limit_params.pattern, '[)]\\s[*]([^()\[\]]+)$', 1), '\', ''), ''), CASE WHEN dimension = 'ratio' THEN '1' END) AS unit
  FROM rules JOIN target ON regexp_matches(lower(numeric_limit_params.parameter_name), '(^|\s)' || q || '\s*$') WHERE kind = 'numeric_limit'),
every AS (SELECT DISTINCT 'cell' AS kind, tag AS owner, quantity, cell_id AS k, value FROM valued WHERE value IS NOT NULL
  UNION ALL SELECT DISTINCT 'rule', name, quantity, rule_no, (number * factor + shift - ts) / tf FROM stated s JOIN alias ON alias.dimension = s.dimension AND alias.alias = {_unit_key('s.unit')} WHERE number IS NOT NULL)
SELECT a.kind, a.k AS key_a, b.k AS key_b FROM every a JOIN every b ON a.kind = b.kind AND a.owner = b.owner AND a.quantity = b.quantity AND a.k < b.k AND abs(a.value - b.value) <= (0.005 + 1e-9) * greatest(abs(a.value), abs(b.value))"""

REPORT = """
WITH i AS (SELECT * FROM {ISSUES} x WHERE included),
m AS (SELECT doc_id, category, type, message, min(issue_id) AS first FROM i GROUP BY ALL),
g AS (SELECT doc_id, category, type, count(*) AS occurrences, coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (WHERE page_number IS NOT NULL)), ', '), '') AS pages FROM i GROUP BY ALL)
SELECT g.doc_id, g.category, g.type, array_to_string(list_transform(string_split(replace(lower(regexp_replace(g.type, '^(rule_|lt_)', '', 'i')), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, occurrences, pages,
  coalesce((SELECT string_agg(message, '; ' ORDER BY first) FROM m WHERE m.doc_id = g.doc_id AND m.category IS NOT DISTINCT FROM g.category AND m.type IS NOT DISTINCT FROM g.type), '') AS messages FROM g"""

# Revisions: the four sources as one list of raw texts, then one form for all.
REVISIONS = rf"""
WITH d AS (SELECT * FROM {{META}} x),
o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, seq, item_id) AS n FROM {_ITEMS} i WHERE page_index = 0 AND text IS NOT NULL),
c AS (SELECT a.doc_id, a.n, regexp_extract(concat_ws(' ', a.text, b.text, e.text), '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])REV(?:ISION)?\s*(?:NO\.?|NUMBER)?\s*[:#._-]?\s*([A-Z0-9]{{1,8}})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1, 'i') AS raw FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.n = a.n + 1 LEFT JOIN o e ON e.doc_id = a.doc_id AND e.n = a.n + 2),
h AS (SELECT doc_id, table_index, col_index, min(row_index) AS head_row FROM {{CELLS}} x WHERE regexp_matches(trim(text), '^(?:REV(?:ISION)?\.?(?:\s*NO\.?)?)$', 'i') GROUP BY ALL),
r AS (SELECT x.doc_id, arg_max(x.text, x.row_index) AS raw FROM {{CELLS}} x JOIN h ON h.doc_id = x.doc_id AND h.table_index = x.table_index AND h.col_index = x.col_index AND x.row_index > head_row WHERE regexp_matches(trim(x.text), '^[A-Za-z0-9]{{1,3}}$') GROUP BY x.doc_id),
s AS (SELECT doc_id, 'FILENAME' AS source, 1 AS pos, regexp_extract(regexp_replace(filename, '\.[^.]*$', ''), '(?:^|[_\s-])REV(?:ISION)?[._\s-]?([A-Z0-9]{{1,8}})(?:$|[._\s-])', 1, 'i') AS raw FROM d
  UNION ALL SELECT doc_id, 'COVER', 2, cover_rev FROM d
  UNION ALL SELECT doc_id, 'COVER_PAGE', 3, arg_min(raw, n) FROM c WHERE raw <> '' GROUP BY doc_id
  UNION ALL SELECT doc_id, 'REVISION_SHEET', 4, raw FROM r),
t AS (SELECT doc_id, source, pos, regexp_replace(regexp_replace(upper(trim(raw)), '^REV(?:ISION)?\s*(?:NO\.?|NUMBER)?\s*[:#.-]?\s*', ''), '[^A-Z0-9]', '', 'g') AS v FROM s),
q AS (SELECT doc_id, source, pos, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN coalesce(nullif(ltrim(v, '0'), ''), '0') ELSE v END AS value FROM t WHERE v <> '' AND length(v) <= 8)
"""
DISAGREEING = REVISIONS + """, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, value) AS votes, min(pos) OVER (PARTITION BY doc_id, value) AS place FROM q),
w AS (SELECT *, max(votes) OVER (PARTITION BY doc_id) AS top, min(value) OVER (PARTITION BY doc_id) AS low, max(value) OVER (PARTITION BY doc_id) AS high FROM k),
z AS (SELECT *, min(CASE WHEN votes = top THEN place END) OVER (PARTITION BY doc_id) AS best FROM w)
SELECT doc_id, source, value FROM z WHERE low <> high AND (top = 1 OR place <> best)"""

O: dict[str, str] = {
    "p1_values": P1_VALUES,
    "p1_found": P1_FOUND,
    "p4_found": P4,
    "p7_found": P7_ALL + "SELECT doc_id, field, iso FROM t9 WHERE iso IS NOT NULL",
    "p4_tables": TABLES_SQL,
    "agg15_report_table": REPORT,
    "txt5_revision_sources": REVISIONS + "SELECT * FROM q",
    "txt5_revision_mismatch": DISAGREEING,
    "fun_roman": ROMAN,
    "fun_decimals": DECIMALS,
    "src8_page_entities": ENTITIES,
    "prj14_evidence_boxes": EVIDENCE,
    "txt13_page_breaks": BREAKS,
    "txt4_reference_drift": DRIFT,
    "txt17_navigation_drift": DRIFT + " WHERE kind <> 'OK'",
    "txt6_citations": CITED + "SELECT * FROM c",
    "txt6_traceability": TRACED,
    "p7_status": P7_ALL + "SELECT doc_id, field, iso, status FROM t9 WHERE iso IS NOT NULL",
}


def oracle_sql() -> dict[str, str]:
    return {name: filled(sql) for name, sql in O.items()}
