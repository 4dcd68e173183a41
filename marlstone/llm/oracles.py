"""SQL for the queries that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS id, y AS other FROM b UNION SELECT r.id, b.y FROM r JOIN b ON r.other = b.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT id, min(other) AS least_id FROM r GROUP BY id) m ON m.id = s.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, h, unhex(h)::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_sum(list_transform(generate_series(1, 5), lambda k: substr(bits, i * 5 + k, 1)::INTEGER * (1 << (5 - k)))) + 1)::INTEGER]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
