"""DuckDB SQL of the queries of this package that SQL can express."""

from .perspectives import BLOCK, SYSTEM, UNKNOWN
from .quality_rules import STOP_WORDS, SYMBOLS, THRESHOLDS

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_VERDICT = " AND ".join(
    f"(1000 * {t.part} {sign} {t.whole} * {bound}" + (f" OR lang IS NULL OR lang NOT IN {t.languages})" if t.languages else ")")
    for t in THRESHOLDS for sign, bound in (("<=", t.most), (">=", t.least)) if bound is not None
)

QUALITY_RULES = rf"""
WITH d AS (
    SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc_id, lang, text,
           regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), g AS (
    SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w
), e AS (
    SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM g
), r AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1
), c AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (VALUES (0), (1), (2)) AS k(k) GROUP BY doc_id
), m AS (
    SELECT g.doc_id, g.lang,
           CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
    FROM g LEFT JOIN c ON g.doc_id = c.doc_id
)
SELECT * EXCLUDE (lang), (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_VERDICT} AS kept
FROM m
"""

PERSPECTIVES = f"""
WITH s AS (
    SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, regexp_replace(coalesce(text, ''), '<(\\\\*)[|]', '<\\\\\\1|', 'g') AS content, file_row AS rowid_
    FROM (SELECT *, row_number() OVER () AS file_row FROM conversations)
), p AS (
    SELECT DISTINCT conv_id AS cast_id, speaker AS perspective FROM s WHERE speaker <> '{SYSTEM}'
), h AS (
    SELECT *, CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                   WHEN speaker = '{SYSTEM}' THEN '<|system|>' || chr(10)
                   ELSE '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\\\*)[|]', '<\\\\\\1|', 'g'), '[|](\\\\*)>', '|\\\\\\1>', 'g') || '|>' || chr(10) END AS head
    FROM s JOIN p ON conv_id IS NOT DISTINCT FROM cast_id
), g AS (
    SELECT *, head || content || '<|end|>' || chr(10) AS segment, turn // {BLOCK} AS part FROM h
), o AS (
    SELECT *, sum(length(segment)) OVER w - length(segment) AS pos FROM g
    WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment, rowid_ ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, CAST(min(pos) AS BIGINT) AS start, string_agg(segment, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(segment) AS BIGINT), ',' ORDER BY pos) FILTER (speaker = perspective), '') AS mask
FROM o GROUP BY ALL
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), k AS (
    SELECT doc_id, len(g) AS n, sha256(array_to_string(list_sort(g), chr(10))) AS class FROM s
), c AS (
    SELECT class, min(doc_id) AS rep, any_value(n) AS n FROM k WHERE n > 0 GROUP BY class
), e AS (
    SELECT rep, n, unnest(g) AS shingle FROM c JOIN s ON rep = doc_id
), p AS (
    SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep < b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (
    SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), walk AS (
    SELECT rep AS node, rep AS top FROM c UNION SELECT links.b, walk.top FROM walk JOIN links ON links.a = walk.node
), m AS (
    SELECT node, min(top) AS top FROM walk GROUP BY node
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.top, k.doc_id) AS component_id, k.doc_id = coalesce(m.top, k.doc_id) AS kept
FROM k LEFT JOIN c ON k.class = c.class AND k.n > 0 LEFT JOIN m ON c.rep = m.node
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
    SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, unnest(list_transform(range(1, len(w) - 33), lambda i: sha256(array_to_string(w[i:i + 34], ' ')))) AS gram
    FROM d WHERE len(w) >= 35
), r AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1
), h AS (
    SELECT DISTINCT doc_id, pos + k AS place FROM r, (SELECT unnest(range(35)) AS k)
), x AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM d
), k AS (
    SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.place) AS kept
    FROM x LEFT JOIN h ON x.doc_id = h.doc_id AND x.place = h.place WHERE h.place IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

DECONTAMINATE = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
    SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0
), p AS (
    SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS gram FROM i
), z AS (
    SELECT DISTINCT size FROM i
), g AS (
    SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS gram
    FROM d, z WHERE len(w) >= size
), f AS (
    SELECT doc_id, pos, g.size AS size, item_id FROM g JOIN p ON g.size = p.size AND g.gram = p.gram
), h AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n FROM f JOIN (SELECT unnest(range(13)) AS k) ON k < f.size GROUP BY doc_id
), o AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""
