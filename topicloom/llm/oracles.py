"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

SHARDS = 40

# CRC-32 of a text: the usual table of 256 remainders, then one step for each byte.
CRC_SQL = """
rem AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
  FROM (SELECT unnest(range(256)) AS i))),
crc AS (SELECT doc_id, text, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, rem)"""
OP7_SQL = f"""
WITH {CRC_SQL},
sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, text_crc32 FROM crc),
run AS (SELECT *, sum(size) OVER (ORDER BY text_crc32, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY text_crc32, doc_id NULLS FIRST, size) AS row_no FROM sized),
cut AS (SELECT *, ((start * {SHARDS}) // total)::INTEGER AS shard FROM run)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_no - min(row_no) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
starts AS (SELECT id, words, unnest(range(1, len(words) - 1)) AS s FROM w),
win AS (SELECT id, s, count(*) OVER (PARTITION BY id, words[s:s + 2]) AS n FROM starts),
rep AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest([s, s + 1, s + 2]) AS p FROM win WHERE n >= 2) GROUP BY id),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT id, len(ws) AS n, row_number() OVER (PARTITION BY id, line ORDER BY pos) > 1 AS again,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[|›»>/•·]'))) AS seps,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, list_sum(list_transform(ws, lambda x: length(x))) AS chars,
    length(regexp_replace(line, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) AS uppers,
    regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}]') AS shout,
    len(regexp_extract_all(line, '!!+|\?\?+')) AS runs,
    regexp_matches(line, '(?i)all rights reserved|licensed under|released under the|copyright|©|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|subscribe to our|sign up for|log ?in to|lorem ipsum') AS boiler,
    right(regexp_replace(line, '[ \t\r\x0B\x0C"''”’»«)\]}›]+$', ''), 1) AS last
  FROM lw WHERE len(ws) > 0),
v AS (SELECT *, again OR (n <= 30 AND boiler) OR (seps >= 2 AND seps > 0.1::DOUBLE * n) OR (symbols >= 2 AND symbols > 0.05::DOUBLE * chars)
    OR ((shout OR runs > 0) AND ((letters >= 12 AND uppers > 0.6::DOUBLE * letters) OR (n >= 3 AND runs > 0.3::DOUBLE * n)))
    OR (n < 25 AND last <> '' AND NOT regexp_matches(last, '[.!?…:;。！？｡؟։।]')) AS bad FROM f),
lines AS (SELECT id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (bad) AS lines_removed, coalesce(sum(n) FILTER (bad), 0) AS words_removed FROM v GROUP BY id),
base AS (SELECT w.id, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lines_removed, 0) AS lines_removed, coalesce(words_removed, 0) AS words_removed
  FROM w LEFT JOIN lines USING (id) LEFT JOIN rep USING (id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND words_removed <= 0.4::DOUBLE * n_words AS kept,
  lines_removed::BIGINT AS lines_removed, words_removed::BIGINT AS words_removed
FROM b"""

OP9_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, 'c' || conv_id || '-' || turn AS own, len(regexp_extract_all(text, '\S+')) AS words FROM conversations),
u AS (SELECT * FROM m WHERE role = 'user'),
depth AS (
  SELECT a.conv_id, a.turn, 0 AS level FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.conv_id, a.turn, d.level + 1 FROM depth d JOIN u a ON a.conv_id = d.conv_id AND a.turn = d.turn + 2),
calls AS (
  SELECT u.conv_id, u.turn, 'call' AS kind, own AS call_id, 'reply' AS tool,
    CASE WHEN EXISTS (SELECT 1 FROM m r WHERE r.conv_id = u.conv_id AND r.role = 'assistant' AND r.turn = u.turn + 1) THEN 'linked' ELSE 'unanswered' END AS status,
    concat_ws(',', CASE WHEN text IS NULL THEN 'missing:prompt' END, CASE WHEN words < 5 OR text IS NULL THEN 'missing:words' END,
      CASE WHEN u.turn >= 2 AND level = 0 THEN 'reference:after' END) AS errors,
    u.turn AS order_turn, level AS order_level, 0 AS order_kind,
    '{"arguments":{' || concat_ws(',', CASE WHEN u.turn >= 2 THEN '"after":"c' || u.conv_id || '-' || (u.turn - 2) || '"' END, '"prompt":' || to_json(text),
      CASE WHEN words >= 5 THEN '"words":' || words END) || '},"id":"' || own || '","name":"reply"}' AS json
  FROM u JOIN depth USING (conv_id, turn)),
results AS (
  SELECT a.conv_id, a.turn, 'result' AS kind, 'c' || a.conv_id || '-' || (a.turn - 1) AS call_id, NULL AS tool,
    CASE WHEN d.level IS NULL THEN 'orphan' ELSE 'linked' END AS status, '' AS errors, a.turn AS order_turn, coalesce(d.level, 0) AS order_level, 1 AS order_kind,
    '{"content":' || to_json(text) || ',"id":"c' || a.conv_id || '-' || (a.turn - 1) || '","role":"tool"}' AS json
  FROM m a LEFT JOIN depth d ON d.conv_id = a.conv_id AND d.turn = a.turn - 1 WHERE a.role = 'assistant'),
plain AS (
  SELECT conv_id, turn, 'message' AS kind, NULL AS call_id, NULL AS tool, 'message' AS status, '' AS errors, turn AS order_turn, 0 AS order_level, 0 AS order_kind,
    '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json
  FROM m WHERE role NOT IN ('user', 'assistant'))
SELECT * FROM calls UNION ALL SELECT * FROM results UNION ALL SELECT * FROM plain"""

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL.replace("SELECT doc_id, text, xor", "SELECT DISTINCT text, xor").replace("FROM documents, rem", "FROM (SELECT coalesce(doc_id::VARCHAR, '') AS text FROM documents), rem").strip()},
d AS (SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front, text FROM documents),
h AS (SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other FROM d),
l AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
s AS (SELECT source, min(id) AS base FROM l GROUP BY source),
up AS (
  SELECT 0 AS level, base, pos, leaf AS h FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT level + 1, base, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM up) WHERE n > 1 GROUP BY level, base, pos // 3),
tops AS (SELECT base, arg_max(h, level) AS subroot FROM up GROUP BY base),
top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY base) - 1 AS pos, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT arg_max(h, level) AS root FROM top),
rise AS (
  SELECT id, base, 0 AS level, pos, '' AS beside, CASE WHEN text_crc32 % 2 = 0 THEN other ELSE leaf END AS now
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN crc ON crc.text = coalesce(l.doc_id::VARCHAR, '')
  UNION ALL
  SELECT r.id, r.base, r.level + 1, r.pos // 3, r.beside || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> r.pos), ''),
    sha256(string_agg(CASE WHEN u.pos = r.pos THEN r.now ELSE u.h END, '' ORDER BY u.pos))
  FROM rise r JOIN up u ON u.base = r.base AND u.level = r.level AND u.pos // 3 = r.pos // 3
  WHERE r.level < (SELECT max(level) FROM up x WHERE x.base = r.base) GROUP BY r.id, r.base, r.level, r.pos, r.beside, r.now),
sub AS (SELECT id, base, arg_max(beside, level) AS beside, arg_max(now, level) AS now FROM rise GROUP BY id, base),
place AS (SELECT base, row_number() OVER (ORDER BY base) - 1 AS pos FROM tops),
on_top AS (
  SELECT id, 0 AS level, pos, beside, now FROM sub JOIN place USING (base)
  UNION ALL
  SELECT r.id, r.level + 1, r.pos // 3, r.beside || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> r.pos), ''),
    sha256(string_agg(CASE WHEN u.pos = r.pos THEN r.now ELSE u.h END, '' ORDER BY u.pos))
  FROM on_top r JOIN top u ON u.level = r.level AND u.pos // 3 = r.pos // 3
  WHERE r.level < (SELECT max(level) FROM top) GROUP BY r.id, r.level, r.pos, r.beside, r.now),
done AS (SELECT id, sha256(arg_max(beside, level)) AS proof_sha256, arg_max(now, level) AS folded_root FROM on_top GROUP BY id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN tops USING (base) JOIN done USING (id), root"""


def _kmeans_rounds(rounds: int) -> str:
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""
n{r} AS MATERIALIZED (SELECT id, arg_min(cluster, (d, cluster)) AS cluster FROM (
  SELECT id, cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{r - 1} c) GROUP BY id),
m{r} AS (SELECT cluster, i, CAST((t - ((t % n) + n) % n) / n AS BIGINT) AS w FROM (
  SELECT cluster, i, sum(w)::BIGINT AS t, count(*) AS n FROM n{r} JOIN e USING (id) GROUP BY cluster, i)),
c{r} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r - 1} c LEFT JOIN (SELECT cluster, list(w ORDER BY i) AS v FROM m{r} GROUP BY cluster) m USING (cluster))""")
    return ",".join(steps)


OP12_SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
e AS MATERIALIZED (SELECT id, unnest(v) AS w, unnest(range(64)) AS i FROM x),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark, v) - 1 AS cluster, v FROM (
  SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS mark, v FROM x ORDER BY mark, v LIMIT 8)),{_kmeans_rounds(10)},
f AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance FROM (
  SELECT id, cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c10 c) GROUP BY id)
SELECT vec_id, f.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM f JOIN x USING (id) JOIN c10 ON c10.cluster = f.cluster"""
