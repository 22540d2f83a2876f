"""SQL for those operators that SQL can express at small scale; the tables are views of the Parquet files."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON reach.r = l.x),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1),
d AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)
"""

URLS = rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ALNUM}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(k) AS n, array_to_string(k, ' ') AS k FROM (SELECT item_id, unnest(CASE WHEN len(ws) >= 13 THEN list_transform(range(1, len(ws) - 11), lambda i: ws[i:i + 12]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS k FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PASSAGES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN firsts USING (k) WHERE doc_id > first),
word AS (SELECT doc_id, j, ws[j] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1) AS again USING (k)),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
placed AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS n FROM placed JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


AUDIT = rf"""
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
earliest AS (SELECT t, min(id) AS first FROM d GROUP BY 1),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
  regexp_matches(t, '[#$%&*|]'), id > first] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM d JOIN earliest USING (t) LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
ends AS (SELECT part, fails, good, toxic, n, o, CASE WHEN fails[strpos('ABCDE', o[1])] THEN 1 WHEN fails[strpos('ABCDE', o[2])] THEN 2 WHEN fails[strpos('ABCDE', o[3])] THEN 3 WHEN fails[strpos('ABCDE', o[4])] THEN 4 WHEN fails[strpos('ABCDE', o[5])] THEN 5 ELSE 6 END AS ends FROM f, orders),
each AS (SELECT part, o AS filter_order, k AS step, o[k] AS filter, n, ends, good, toxic, fails[strpos('ABCDE', o[k])] AS hit, fails[1]::INT + fails[2]::INT + fails[3]::INT + fails[4]::INT + fails[5]::INT AS all_hits FROM ends, range(1, 6) AS r(k)),
steps AS (SELECT part, filter_order, step, filter, sum(CASE WHEN ends > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN ends = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND ends < step THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN hit AND all_hits = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN ends = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN ends = step AND toxic THEN n ELSE 0 END) AS toxic_lost FROM each GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM steps
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS ws FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
b AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN b USING (term) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) JOIN total ON true),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS x FROM p JOIN w USING (term) JOIN total ON true),
s AS (SELECT item_id, doc_id, CAST(sum(q * x) AS BIGINT) AS score FROM b JOIN i USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def shards(keys: list[int], shards: int = 16) -> str:
    """SQL of the sharding: checksums over bytes, a Feistel round for each key, and walks until a number is inside."""
    rounds = "SELECT id, n, side, v // side AS l, v % side AS r FROM walk JOIN total ON true WHERE k = 0 OR v >= n"
    for key in keys:
        mixed = f"SELECT *, (r * {key} + {key % 65521}) % 2147483647 AS t FROM ({rounds})"
        rounds = f"SELECT id, n, side, r AS l, (l + xor(t, t >> 13) * 1103515245 % 2147483629) % side AS r FROM ({mixed})"
    return f"""
WITH RECURSIVE steps AS (SELECT c, c AS v, 0 AS k FROM range(256) AS x(c) UNION ALL SELECT c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY c) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d JOIN crc ON true),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM s),
total AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM documents),
walk AS (SELECT row_number AS id, row_number AS v, 0 AS k FROM numbered UNION ALL SELECT id, l * side + r, 1 FROM ({rounds})),
ends AS (SELECT id, v FROM walk JOIN total ON true WHERE k = 1 AND v < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, CAST(v // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number FROM numbered JOIN ends ON id = row_number
"""


def rules(stop_words: list[str], limits: dict[str, float]) -> str:
    """SQL of the quality rules with the limits of the threshold table."""
    listed = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED[:-1]}')) AS ls FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, k FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri JOIN again USING (doc_id, k)) GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, greatest(len(ws), 1) AS n1, greatest(len(ls), 1) AS l1,
  len(list_filter(ws, lambda w: lower(rtrim(w, '.,!')) IN ({listed}))) AS stops FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n1 >= {limits['short_words']} AND word_chars / n1 <= {limits['long_words']} AND n_symbols / n1 <= {limits['symbols']} AND n_dup_lines / l1 <= {limits['same_lines']} AND stops / n1 >= {limits['few_stop_words']} AS kept
FROM f
"""
