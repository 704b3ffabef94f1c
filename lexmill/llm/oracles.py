"""SQL for DuckDB of the queries of shards, resampling and the prefix trie."""

from __future__ import annotations

#: Of CRC-32, by its polynomial: what a byte adds.
_CRC_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY i) FROM range(256) r(i))"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; ``t`` is the table."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


OP11 = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns FROM said GROUP BY conv_id),
head AS (SELECT conv_id, turns, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM conv, crc),
whole AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1 : c.h], c.turns[c.h + 1 :]) AS path
  FROM head c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20),
step AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM whole),
node AS (SELECT depth, path[1 : depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(path)) AS deepest,
    string_agg(CASE WHEN len(path) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM step GROUP BY 1, 2),
cost AS (SELECT depth, prefix, deepest, (n_convs - 1) * len(regexp_extract_all(coalesce(prefix[depth].text, ''), '[^\x20\x09-\x0D]+')) AS saved FROM node),
above AS (SELECT unnest(range(0, depth + 1)) AS top, * FROM cost),
sub AS (SELECT top AS depth, prefix[1 : top] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (deepest = depth) AS n_leaves,
    count(*) FILTER (depth = top + 1) AS n_children FROM above GROUP BY 1, 2)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sub s ON s.depth = n.depth AND s.prefix = n.prefix LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
"""

OP12 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, md5(coalesce(text, '')) AS h, {_crc32("coalesce(text, '')")}::BIGINT AS text_crc32, row_number() OVER () AS r FROM documents, crc),
marked AS (SELECT *, size * 32 * 40 > (SELECT sum(size) FROM d) AS heavy FROM d),
heavy AS (SELECT r, size, row_number() OVER (ORDER BY size DESC, h, doc_id NULLS FIRST, r) AS i FROM marked WHERE heavy),
dealt(i, loads, counts, r, shard, slot) AS (
  SELECT 0::BIGINT, list_transform(range(40), lambda x: 0::BIGINT), list_transform(range(40), lambda x: 0::BIGINT), NULL::BIGINT, NULL::INTEGER, NULL::BIGINT
  UNION ALL
  SELECT n.i, list_transform(loads, lambda v, k: v + CASE WHEN k = n.at THEN n.size ELSE 0 END), list_transform(counts, lambda v, k: v + CASE WHEN k = n.at THEN 1 ELSE 0 END), n.r, (n.at - 1)::INTEGER, counts[n.at]
  FROM (SELECT h.i, h.r, h.size, x.loads, x.counts, list_position(x.loads, list_min(x.loads)) AS at FROM dealt x JOIN heavy h ON h.i = x.i + 1) n),
filled AS (SELECT loads, counts FROM dealt ORDER BY i DESC LIMIT 1),
loads AS (SELECT unnest(range(40)) AS shard, unnest(loads) AS load FROM filled),
rest AS (SELECT coalesce(sum(size), 0)::BIGINT AS rest FROM marked WHERE NOT heavy),
levels AS (SELECT load, row_number() OVER (ORDER BY load, shard) AS k, sum(load) OVER (ORDER BY load, shard ROWS UNBOUNDED PRECEDING) AS below FROM loads),
level AS (SELECT k, rest + below AS water FROM levels, rest WHERE rest + below >= k * load ORDER BY k DESC LIMIT 1),
edges AS (SELECT shard, (sum(greatest(0, water - k * load)) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) // k)::BIGINT AS edge FROM loads, level),
inner_edges AS (SELECT list(edge) AS listed FROM edges WHERE shard < 39),
light AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, r ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM marked WHERE NOT heavy),
cut AS (SELECT l.*, len(list_filter(listed, lambda e: 2 * e <= 2 * upto - size))::INTEGER AS shard FROM light l, inner_edges),
placed AS (SELECT doc_id, size, text_crc32, c.shard, row_number() OVER (PARTITION BY c.shard ORDER BY upto) - 1 + f.counts[c.shard + 1] AS slot FROM cut c, filled f
  UNION ALL SELECT doc_id, m.size, text_crc32, shard, slot FROM marked m JOIN dealt USING (r))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, slot::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
word AS (SELECT r, unnest(words) AS w FROM d), target AS (SELECT unnest(words) AS w FROM b),
known AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM word UNION SELECT w FROM target), crc),
s AS (SELECT bucket, count(*) AS s FROM word JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN known USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
total AS (SELECT r, sum(gain)::BIGINT AS total, count(*) AS n FROM word JOIN known USING (w) JOIN gain USING (bucket) GROUP BY r),
weighed AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN total USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)
"""
