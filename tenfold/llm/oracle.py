"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

from .common import ALNUM_WORDS, LOWER, SPACE_WORDS, UPPER
from .decontaminate import NEAR
from .licenses import PHRASES, TELLING, TEMPLATES, THRESHOLD, words
from .line_dedup import LEAST_PAGES, RATIO
from .merkle import FIELDS
from .quality import LEAST_GROUP, MARKS, MEASURES, SPREAD
from .secret_scan import BASE, RULES
from .warc import REVISIT_BYTES

HAS_WORD = r"regexp_matches(l, '[^\x20\x09-\x0D]')"


def crc32(text: str) -> str:
    """The unsigned crc32 of a text of ASCII characters, bit by bit: zlib's polynomial, reflected."""
    bits = f"list_reduce([xor(c, b), {', '.join('0' * 8)}], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _quality() -> str:
    values = ", ".join(f"CASE WHEN {of} > 0 THEN (1000000 * {counted}) // {of} END AS {m}" for m, (counted, of, _) in MEASURES.items())
    # what is below 256 stays, all else is numbered by its power of two and its first eight binary digits
    buckets = ", ".join(f"CASE WHEN {m} < 256 THEN {m} ELSE (length(bin({m})) - 8) * 128 + ({m} >> (length(bin({m})) - 8)) END AS {m}" for m in MEASURES)
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM b WHERE {m} IS NOT NULL" for m in MEASURES)
    reach = f"{SPREAD} * least(q3 - q2, q2 - q1)"
    spread = lambda x: f"{x}.q1 > 0 AND {x}.q1 < {x}.q2 AND {x}.q2 < {x}.q3"
    row = lambda x: f"{{'q1': {x}.q1, 'q2': {x}.q2, 'q3': {x}.q3}}"
    one_sided = ", ".join(f"'{m}'" for m, (*_, lower) in MEASURES.items() if not lower)
    bad = " OR ".join(f"measure = '{m}' AND NOT {m} BETWEEN lo AND hi" for m in MEASURES)

    def quartiles(name: str, *by: str) -> str:
        of = ", ".join([*by, "measure"])
        return f"""{name} AS (SELECT {of}, min(n) AS n, min(v) FILTER (WHERE 100 * c >= 25 * n) AS q1, min(v) FILTER (WHERE 100 * c >= 50 * n) AS q2, min(v) FILTER (WHERE 100 * c >= 75 * n) AS q3
    FROM (SELECT {of}, v, sum(count(*)) OVER (PARTITION BY {of} ORDER BY v) AS c, sum(count(*)) OVER (PARTITION BY {of}) AS n FROM e GROUP BY {of}, v) GROUP BY {of})"""

    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source,
    regexp_extract_all(coalesce(text, ''), '{SPACE_WORDS}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {HAS_WORD}) AS lines FROM documents),
g AS (SELECT doc_id, i, words[i:i+4] AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(array_to_string(words, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(array_to_string(words, ''), '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(length(regexp_replace(array_to_string(words, ''), '[^{MARKS[1:]}', '', 'g')) AS BIGINT) AS n_marks, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {values} FROM m),
b AS (SELECT * REPLACE ({buckets}) FROM v),
e AS ({each}),
{quartiles("qa", "lang", "source")},
{quartiles("qb", "lang")},
{quartiles("qc")},
q AS (SELECT lang, source, measure, unnest(CASE WHEN a.n >= {LEAST_GROUP} AND {spread('a')} THEN {row('a')} WHEN b.n >= {LEAST_GROUP} AND {spread('b')} THEN {row('b')} WHEN {spread('c')} THEN {row('c')} END)
    FROM qa a JOIN qb b USING (lang, measure) JOIN qc c USING (measure)),
lim AS (SELECT lang, source, measure, q2 + {reach} AS hi, CASE WHEN measure IN ({one_sided}) THEN -1 ELSE q2 - {reach} END AS lo FROM q WHERE q2 IS NOT NULL),
o AS (SELECT DISTINCT doc_id FROM b JOIN lim USING (lang, source) WHERE {bad})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept FROM b LEFT JOIN o ON b.doc_id = o.doc_id"""


def _licenses() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = " UNION ALL ".join(f"SELECT {k} AS id, '{label}' AS label, {quoted(sorted({w.decode() for w in words(text)}))} AS tokens, {quoted(sorted(TELLING.intersection(w.decode() for w in words(text))))}::VARCHAR[] AS needed" for k, (label, text) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS word, '{label}' AS label FROM p WHERE words[i:i+{len(words(p)) - 1}] = {quoted(w.decode() for w in words(p))}" for p, label in PHRASES.items())
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH t AS ({templates}),
d AS (SELECT doc_id, {low} AS t, regexp_extract_all({low}, '{ALNUM_WORDS}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM d),
f AS ({phrases}),
b AS (SELECT doc_id, min(word) AS first_word, max(word) AS last_word, count(*) AS n, list(DISTINCT label) AS labels FROM f GROUP BY doc_id),
l AS (SELECT doc_id, row_number() OVER () AS line, list_distinct(regexp_extract_all(line, '{ALNUM_WORDS}')) AS own FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
h AS (SELECT doc_id, line, label, list_intersect(own, tokens) AS held, len(tokens) AS size FROM l, t WHERE len(list_intersect(own, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(own, needed)),
c AS (SELECT doc_id, label, len(held) / size AS share FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.line = h.line AND len(o.held) > len(h.held) AND list_has_all(o.held, h.held))),
x AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, b.first_word, b.last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ',') AS labels,
    CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(x.share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN x ON d.doc_id = x.doc_id"""


def _decontamination() -> str:
    found = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORDS}')"
    return rf"""
WITH i AS (SELECT item_id, {found('text')} AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[k:k+12], ' ') AS gram
    FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 12))) AS k FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, {found('text')} AS words FROM documents),
g AS (SELECT doc_id, size, k, array_to_string(words[k:k+size-1], ' ') AS gram
    FROM (SELECT doc_id, size, words, unnest(generate_series(1, len(words) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM w))),
m AS (SELECT doc_id, k, g.size, item_id FROM g JOIN w ON g.gram = w.gram AND g.size = w.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS found FROM m GROUP BY doc_id),
-- near matches: of each window, the rarest different words that any near match has one of, and what stands around them
u AS (SELECT gram, unnest(list_distinct(string_split(gram, ' '))) AS term FROM (SELECT DISTINCT gram FROM w)),
c AS (SELECT unnest(words) AS term, count(*) AS n FROM d GROUP BY term),
r AS (SELECT gram, term, row_number() OVER (PARTITION BY gram ORDER BY coalesce(n, 0), term) AS turn, ceil({NEAR} * count(*) OVER (PARTITION BY gram)) AS least, count(*) OVER (PARTITION BY gram) AS different FROM u LEFT JOIN c USING (term)),
q AS (SELECT gram, term, least FROM r WHERE turn <= different - least + 1),
o AS (SELECT doc_id, pos, words[pos] AS term, words[greatest(1, pos - 12):pos + 12] AS around FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM d)),
n AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS near FROM o JOIN q USING (term) JOIN w USING (gram) WHERE len(list_intersect(list_distinct(around), string_split(gram, ' '))) >= least GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
    sha256(array_to_string(coalesce(found, []), ',')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(words) AS contaminated,
    CAST(coalesce(len(near), 0) AS BIGINT) AS n_near, array_to_string(coalesce(near, []), ',') AS near_items
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""


def _warc() -> str:
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


def _line_dedup() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT host, l, count(*) AS n FROM (SELECT host, unnest(list_distinct(string_split(t, chr(10)))) AS l FROM d) WHERE {HAS_WORD} GROUP BY host, l),
s AS (SELECT host, list(l) AS bad FROM c JOIN (SELECT host, count(*) AS total FROM d GROUP BY host) USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total GROUP BY host),
x AS (SELECT doc_id, lines, list_filter(lines, lambda l: NOT {HAS_WORD} OR NOT list_contains(coalesce(bad, []), l)) AS good FROM d LEFT JOIN s USING (host))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(good), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(good, chr(10)), '')) AS kept_sha256 FROM x"""


def _merkle(heights: tuple[int, int] = (10, 4)) -> str:
    """Levels are written out, ten for documents and four for languages, which is 8 ** 10 and 8 ** 4 nodes."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    one_side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {frame}), '')"
    before, after = one_side("UNBOUNDED PRECEDING AND 1 PRECEDING"), one_side("1 FOLLOWING AND UNBOUNDED FOLLOWING")

    def tree(name: str, height: int) -> str:
        """Levels name0 (g, i, h, n) to name<height>, and for each the siblings of its nodes."""
        parts = []
        for k in range(height):
            parts.append(f"{name}s{k} AS MATERIALIZED (SELECT g, i, n, {before} AS b, {after} AS a FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY g, i // 8)")
        return ", ".join(parts)

    def climbed(name: str, height: int, start: str) -> str:
        """The proof and the root folded from ``start`` (its rows have g, i, f, p), level by level."""
        parts, last = [], start
        for k in range(height):
            parts.append(f"{name}c{k} AS MATERIALIZED (SELECT c.* REPLACE (c.i // 8 AS i, CASE WHEN n > 1 THEN sha256(b || f || a) ELSE f END AS f, p || b || a AS p) FROM {last} c JOIN {name}s{k} s ON c.g = s.g AND c.i = s.i)")
            last = f"{name}c{k}"
        return ", ".join(parts)

    return rf"""
WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf,
    CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS received FROM documents),
l0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, received FROM d),
{tree('l', heights[0])},
r0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM l{heights[0]}),
{tree('r', heights[1])},
start AS (SELECT g, i, doc_id, h AS leaf, coalesce(received, h) AS f, '' AS p FROM l0),
{climbed('l', heights[0], 'start')},
up AS (SELECT '' AS g, r0.i, doc_id, leaf, r0.h AS subroot, f, p FROM lc{heights[0] - 1} x JOIN r0 ON x.g = r0.lang),
{climbed('r', heights[1], 'up')}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM rc{heights[1] - 1} CROSS JOIN r{heights[1]} r"""


def _secrets() -> str:
    # this engine folds case beyond ASCII, so both cases are written out
    cased = lambda p: re.sub(r"\(\?i:([^)]*)\)", lambda m: f"(?:{re.sub('[a-z]', lambda x: f'[{x[0].upper()}{x[0]}]', m[1])})", p).replace("'", "''")
    matches = " UNION ALL ".join(f"SELECT doc_id, {k} AS o, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{cased(r.pattern)}', 0) AS m, regexp_extract_all(t, '{cased(r.pattern)}', {r.group}) AS g, string_split_regex(t, '{cased(r.pattern)}') AS p FROM d" for k, r in enumerate(RULES))
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    base, names = len(BASE), ", ".join(f"count(*) FILTER (WHERE o = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({matches}),
e AS (SELECT *, unnest(generate_series(1, len(m))) AS k FROM r WHERE len(m) > 0),
s AS (SELECT doc_id, o, kind, CAST({total('p[1:k]')} + {total('m[1:k-1]')} AS BIGINT) AS first, length(m[k]) AS size FROM e WHERE length(g[k]) >= least),
x AS (SELECT doc_id, o, first, kind || ':' || first || ':' || first + size AS shown FROM s),
a AS (SELECT doc_id, {names}, string_agg(shown, ',' ORDER BY first, o) FILTER (WHERE o < {base}) AS base, string_agg(shown, ',' ORDER BY first, o) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


SQL = {"op2_quality_rules": _quality(), "op3_license_scan": _licenses(), "op5_decontamination": _decontamination(), "op7_warc": _warc(), "op8_line_dedup": _line_dedup(), "op11_merkle_manifest": _merkle(), "op13_secret_scan": _secrets()}
