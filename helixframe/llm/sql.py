"""SQL of those numbered queries that a database without their hashes can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

SQL = {
    "op4_decontaminate": r"""WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL
        UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark WHERE item_id IS NOT NULL),
      s AS (SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
      q AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
      m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM s d JOIN s i ON i.side = 'i' AND i.shingle = d.shingle WHERE d.side = 'd' GROUP BY ALL)
      SELECT doc_id, item_id, m.n AS n_matched, q.n AS n_shingles, m.n / q.n AS containment FROM m JOIN q ON q.id = m.item_id WHERE m.n >= 0.8::DOUBLE * q.n - 1e-9""",
    "op5_substrings": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
      win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
      dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
      isle AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50)::INT AS apart FROM dup)),
      span AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM isle GROUP BY doc_id, k),
      gone AS (SELECT doc_id, unnest(range(s, e)) AS p FROM span),
      word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
      FROM d LEFT JOIN (SELECT doc_id, sum(e - s) AS n FROM span GROUP BY doc_id) g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op7_suffixes": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
      win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d)),
      dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
      isle AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -999) + 100)::INT AS apart FROM dup)),
      span AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM isle GROUP BY doc_id, k),
      edge AS (SELECT doc_id, e AS s, lead(s, 1) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM span UNION ALL SELECT doc_id, 0, min(s) FROM span GROUP BY doc_id),
      kept AS (SELECT doc_id, string_agg(substr(x, 2 * edge.s + 1, 2 * (coalesce(edge.e, n) - edge.s)), '' ORDER BY edge.s) AS x FROM d JOIN edge USING (doc_id) GROUP BY doc_id)
      SELECT d.doc_id, d.n AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.k, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
      FROM d LEFT JOIN (SELECT doc_id, sum(e - s) AS n, count(*) AS k FROM span GROUP BY doc_id) g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS x FROM pages),
      d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest FROM p),
      f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (payload_digest)""",
    "op13_prefix_trie": rf"""WITH RECURSIVE bits AS (SELECT n, list_reduce([n::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)),
      tab AS (SELECT list(v ORDER BY n) AS tab FROM bits),
      t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) - 1 AS i
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
      c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
      h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, (4294967295 - list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % 4 AS h FROM c, tab),
      l AS (SELECT h.*, least(h, coalesce(c.n, 0)) AS lead FROM h LEFT JOIN c ON c.conv_id = h.base),
      r AS (SELECT l.conv_id, i, role, text FROM l JOIN t ON t.conv_id = l.base AND i < lead UNION ALL SELECT l.conv_id, i - h + lead, role, text FROM l JOIN t ON t.conv_id = l.conv_id AND i >= h),
      p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS key, '' AS above, 0::BIGINT AS words FROM c UNION ALL
        SELECT p.conv_id, depth + 1, sha256(key || length(role)::VARCHAR || ':' || role || text), key, len(regexp_extract_all(text, '{_WORDS}')) FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.depth),
      m AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY 1),
      e AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN m USING (conv_id) WHERE depth = n GROUP BY ALL),
      g AS (SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM p GROUP BY depth, key),
      k AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n FROM g WHERE depth > 0 GROUP BY ALL),
      x AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (depth, key)),
      s AS (SELECT a.depth, a.key, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved) AS saved_tokens FROM p a JOIN x ON x.conv_id = a.conv_id AND x.depth >= a.depth GROUP BY ALL)
      SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
      FROM x JOIN s USING (depth, key) LEFT JOIN e USING (depth, key) LEFT JOIN g up ON up.depth = x.depth - 1 AND up.key = x.above""",
}
