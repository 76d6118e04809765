"""DuckDB's SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import math

from onoma.llm.common import LOWER, UPPER, python_words
from onoma.llm.license_scan import PHRASES, TEMPLATES

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM items, unnest(range(1, len(w) - k + 2)) AS u(i)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM docs, (SELECT DISTINCT k FROM wins) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT * FROM places WHERE (k, win) IN (SELECT (k, win) FROM wins)),
n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits JOIN wins USING (k, win) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hits USING (doc_id) LEFT JOIN found USING (doc_id)"""

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, i, line, regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS key
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
hot AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h USING (key) GROUP BY doc_id"""


def _places(phrase: str) -> str:
    words = phrase.split(" ")
    same = " AND ".join(f"w[i{f' + {j}' if j else ''}] = '{x}'" for j, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


def license_scan(threshold: float = 0.9, stretch: int = 2) -> str:
    sets = [(label, sorted(set(python_words(text)))) for label, text in TEMPLATES]
    rows = ", ".join(f"({i}, '{label}', {own!r}, {math.ceil(threshold * len(own))}, {stretch * len(python_words(text))})" for i, ((label, own), (_, text)) in enumerate(zip(sets, TEMPLATES, strict=True)))
    own = ", ".join(f"{_places(p)} AS p{i}" for i, p in enumerate(PHRASES.values()))
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES))
    return f"""
WITH docs AS (SELECT doc_id, {_LOWERED} AS t, {_WORDS} AS w FROM documents),
phrases AS (SELECT doc_id, len(w) AS n, list_concat({", ".join(f"p{i}" for i in range(len(PHRASES)))}) AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM (SELECT doc_id, w, {own} FROM docs)),
templates(id, label, own, need, reach) AS (VALUES {rows}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS held FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS token FROM docs),
tokens AS (SELECT id, label, len(own) AS n, need, reach, unnest(own) AS token FROM templates),
windows AS (SELECT doc_id, label, n, need, count(DISTINCT token) OVER (PARTITION BY doc_id, id ORDER BY i RANGE BETWEEN CURRENT ROW AND reach - 1 FOLLOWING) AS shared FROM places JOIN tokens USING (token)),
found AS (SELECT doc_id, label, shared / n AS share FROM windows WHERE shared >= need
  UNION ALL SELECT doc_id, label, shared / n FROM (SELECT doc_id, label, need, len(own) AS n, len(list_intersect(held, own)) AS shared FROM lines, templates) WHERE shared >= need),
matches AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS most FROM found GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM phrases LEFT JOIN matches USING (doc_id)"""


SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM docs, unnest(range(0, length(x) // 2 - 399)) AS u(i)),
hits AS (SELECT doc_id, i FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hits)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM marked GROUP BY doc_id, run),
cut AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

_TOKENS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

MIX_TARGETS = f"""
WITH sizes AS (SELECT doc_id, source, len({_TOKENS})::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size) AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sizes GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS total FROM sources),
levels AS (SELECT l.level, sum(least(3.0::DOUBLE * s.n, l.level * s.w)) AS filled, sum(CASE WHEN 3.0::DOUBLE * s.n > l.level * s.w THEN s.w ELSE 0 END) AS open FROM (SELECT DISTINCT 3.0::DOUBLE * n / w AS level FROM sources UNION SELECT 0.0) AS l, sources AS s GROUP BY l.level),
reached AS (SELECT max_by(level + CASE WHEN open > 0 THEN (total - filled) / open ELSE 0 END, level) AS level FROM levels, whole WHERE filled <= total)
SELECT doc_id, size, n::BIGINT AS source_size, round(least(3.0::DOUBLE * n, reached.level * w), 3) AS target FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source, reached"""

QUALITY_BASE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_TOKENS} AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM docs, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT doc_id, count(DISTINCT p) AS n FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g), unnest(range(i, i + 5)) AS v(p) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(twice.n, 0)::BIGINT AS n_repeat_words, (len(w) < 10 OR 100 * coalesce(twice.n, 0) > 20 * len(w)) AS base_failed
FROM docs LEFT JOIN twice USING (doc_id) LEFT JOIN lines USING (doc_id)"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i::INT]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{_DIGITS}[i::INT]::INT + 1] END)) % 10 = 0"
PII_BASE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+){{3}}'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(right(p, 3), 3, '0') > '255')) = 0))::BIGINT AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}))::BIGINT AS n_card,
  len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 8 AND 15))::BIGINT AS n_phone FROM docs"""


ORACLES = {
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_decontamination": DECONTAMINATION,
    "op7_license_scan": license_scan(),
    "op9_line_dedup": LINE_DEDUP,
    "pii_base": PII_BASE,
    "mix_targets": MIX_TARGETS,
    "quality_base": QUALITY_BASE,
}
