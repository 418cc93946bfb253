"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from basewright.llm import decontaminate, html_text, lines, minhash, pieces, quality, rlz, sharding, suffixes, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_sharding": sharding.op2_sharding,
    "op3_minhash": minhash.op3_minhash,
    "op4_substring_dedup": rlz.op4_substring_dedup,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_suffix_array": suffixes.op9_suffix_array,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLES = {
    "op2_sharding": """
WITH RECURSIVE steps AS (SELECT 0 AS s, list_transform(range(256), lambda i: i::BIGINT) AS t
  UNION ALL SELECT s + 1, list_transform(t, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM steps WHERE s < 8),
tab AS (SELECT t FROM steps WHERE s = 8),
d AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, octet_length(encode(body))::BIGINT + 8 AS size,
    xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, (t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM d, tab),
draws AS (SELECT doc_id, shard, -ln((('0x' || substr(md5(':' || doc_id || ':' || shard), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS cost
  FROM documents, range(25) r(shard)),
best AS (SELECT doc_id, arg_min(shard, cost) FILTER (shard < 24) AS shard, arg_min(shard, cost) AS grown_shard FROM draws GROUP BY doc_id)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || text_crc32), doc_id, size) - 1 AS slot
FROM c JOIN best USING (doc_id)""",
    "op3_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN sz p ON p.doc_id = a.doc_id JOIN sz q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN sz USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) m USING (doc_id)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM g) WHERE n > 1),
isl AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM
  (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 35 THEN 0 ELSE 1 END AS fresh FROM bad)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 35 AS b FROM isl GROUP BY doc_id, k),
part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT doc_id, sum(b - a) AS removed, max(b) AS last, flatten(list(d.w[before + 1:a] ORDER BY a)) AS pieces FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN removed IS NULL THEN w ELSE list_concat(pieces, w[last + 1:]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op7_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM bw, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
sizes AS (SELECT DISTINCT n FROM iw),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, iw.item_id FROM grams g JOIN iw ON g.t = iw.t AND g.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, h,
        max(page_id) OVER (PARTITION BY h) AS head,
        list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT) AS parts FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM d""",
    "op9_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM g) WHERE m < doc_id),
isl AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM
  (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM bad)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY doc_id, k),
part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
    string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS pieces FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE pieces || substr(h, (2 * last + 1)::INT) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
}
