"""SQL twins of the corpus queries that SQL can express."""

_DOCUMENT_STATS = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {host} AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT k, unnest(range(1, len(ws) - 3)) AS i, unnest([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) AS g FROM w),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT k, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k),
s AS (SELECT w.k, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (base_failed) AS host_failed, count(*) FILTER (n_words < 10) AS failed_short,
             count(*) FILTER (100 * n_repeat_words > 20 * n_words) AS failed_repetitive, count(*) FILTER (100 * n_symbols > 10 * word_chars) AS failed_symbols,
             count(*) FILTER (100 * n_dup_lines > 30 * n_lines) AS failed_dup_lines FROM b WHERE source IS NOT NULL GROUP BY source),
e AS (SELECT source, CAST(host_docs AS DOUBLE) AS n, unnest(['short', 'repetitive', 'symbols', 'dup_lines']) AS rule,
             unnest([failed_short, failed_repetitive, failed_symbols, failed_dup_lines]::DOUBLE[]) AS f FROM h),
t AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS nn, sum(n * n) AS n2, sum(f * f / n) AS q, count(*) - 1 AS free FROM e GROUP BY rule),
p AS (SELECT rule, m, least(greatest(0.3e0, 3e0 * m), (1 + m) / 2) AS top, CASE WHEN m <= 0 OR m >= 1 OR room <= 0 OR beyond <= 1 / 10001e0 THEN 10000e0
             ELSE greatest(1 / beyond - 1, 0e0) END AS s
      FROM (SELECT *, nn - n2 / nn - free AS room, CASE WHEN m > 0 AND m < 1 AND nn - n2 / nn - free > 0 THEN ((q - m * m * nn) / (m * (1 - m)) - free) / (nn - n2 / nn - free) END AS beyond FROM t)),
r AS (SELECT h.*, host_rejected FROM h JOIN (SELECT source, bool_or((f + s * m) / (n + s) > top) AS host_rejected FROM e JOIN p USING (rule) GROUP BY source) USING (source))
"""
QUALITY_RULES = _DOCUMENT_STATS.replace("{host}", "source") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failed,
       coalesce(host_rejected, false) AS host_rejected, NOT (base_failed OR coalesce(host_rejected, false)) AS kept
FROM b LEFT JOIN r USING (source)
"""
#: Hosts that are each source by length of document.
HOST_VERDICTS = _DOCUMENT_STATS.replace(
    "{host}", "source || '/' || CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 1000 THEN 'medium' WHEN n_chars IS NOT NULL THEN 'long' END"
) + """
SELECT source AS host, host_docs, host_failed, failed_short, failed_repetitive, failed_symbols, failed_dup_lines, host_rejected FROM r
"""

CONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, unnest([array_to_string(ws[j:j + n - 1], ' ') for j in range(1, len(ws) - n + 2)]) AS g FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cut AS (SELECT k, n, unnest(range(1, len(ws) - n + 2)) AS s, unnest([array_to_string(ws[j:j + n - 1], ' ') for j in range(1, len(ws) - n + 2)]) AS g FROM d CROSS JOIN sizes WHERE len(ws) >= n),
hit AS (SELECT k, n, s, item_id FROM cut JOIN win USING (n, g)),
places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (k) LEFT JOIN items USING (k)
"""


def licenses(templates: list[tuple[str, str]], threshold: float) -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    cut = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT DISTINCT k, unnest(string_split(t, chr(10)) || string_split_regex(t, '\n[\x20\x09-\x0D]*\n') || [t]) AS s FROM d),
w AS (SELECT k, s, {cut.format("s")} AS ws FROM s),
b AS (SELECT k, s, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS g FROM w WHERE len(ws) > 1),
tw AS (SELECT i, name, {cut.format("t")} AS ws FROM (VALUES {values}) v(i, name, t)),
tb AS (SELECT i, name, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS h FROM tw),
m AS (SELECT k, name, 2e0 * len(list_intersect(g, h)) / (len(g) + len(h)) AS score FROM b JOIN tb ON len(g) <= 1.6 * len(h) AND len(h) <= 1.6 * len(g)),
best AS (SELECT k, count(*) AS n, max(score) AS score FROM m WHERE score >= {threshold}e0 GROUP BY k),
named AS (SELECT k, min(name) AS name FROM m JOIN best USING (k, score) GROUP BY k)
SELECT doc_id, name AS license, coalesce(score, 0e0) AS score, coalesce(n, 0) AS n_matches
FROM d LEFT JOIN best USING (k) LEFT JOIN named USING (k)
"""
