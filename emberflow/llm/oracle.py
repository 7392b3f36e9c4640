"""DuckDB SQL for those queries that SQL can express over whole tables.

The others (1, 2, 4, 5, 7, 9, 10) are compared with brute force in tests/llm.
"""

from __future__ import annotations

#: Operator 3: what the records must say, from the pages themselves.
WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest
"""

#: Operator 8: the rules tried from the longest to the shortest.
URLS = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     t AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
     u AS (SELECT *, CASE
         WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM u
"""


def _covered(k: int) -> str:
    """Whether a word stands in a k-word window that the text has twice or more."""
    return f"""c{k} AS (SELECT doc_id, i, chars, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS inside FROM (
        SELECT *, key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1 AS twice FROM (
        SELECT doc_id, i, length(l[i]) AS chars, CASE WHEN i + {k - 1} <= len(l) THEN array_to_string(l[i:i + {k - 1}], ' ') END AS key FROM w))),
     s{k} AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS words, sum(CASE WHEN inside = 1 THEN chars ELSE 0 END) / sum(chars) AS share FROM c{k} GROUP BY 1)"""


#: Operator 6: the counts and shares from the words themselves.
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
     w AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
     {", ".join(_covered(k) for k in (3, 5, 8, 10))},
     lines AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line) AS nth
               FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
     dl AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM lines WHERE nth > 1 AND chars > 0 GROUP BY 1),
     t AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
     a AS (SELECT t.*, coalesce(dl.n, 0) AS n_dup_lines, coalesce(s3.words, 0) AS n_repeat_words, coalesce(dl.chars / word_chars, 0)::DOUBLE AS dup_line_chars,
                  coalesce(s5.share, 0)::DOUBLE AS dup_5gram_chars, coalesce(s8.share, 0)::DOUBLE AS dup_8gram_chars, coalesce(s10.share, 0)::DOUBLE AS dup_10gram_chars
           FROM t LEFT JOIN dl USING (doc_id) LEFT JOIN s3 USING (doc_id) LEFT JOIN s5 USING (doc_id) LEFT JOIN s8 USING (doc_id) LEFT JOIN s10 USING (doc_id)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR dup_line_chars > 0.3 OR dup_5gram_chars > 0.35 OR dup_8gram_chars > 0.3 OR dup_10gram_chars > 0.25 OR n_symbols > 0.3::DOUBLE * n_words) AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_round_trip": WARC, "op6_repetition_quality": QUALITY, "op8_url_filter": URLS}
