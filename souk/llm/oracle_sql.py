"""DuckDB SQL twins of the queries that SQL can express."""

from __future__ import annotations

OP11 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

# The levels of both trees, from the leaves up; a proof joins the sibling of every level.
# CRC-32 of the id's digits is taken bit by bit (reflected polynomial 0xEDB88320).
OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS said,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS changed,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(list_transform(range(8 * length(doc_id::VARCHAR)),
           lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END),
           lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END),
           4294967295::BIGINT)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, pos, sha256(head || said || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || changed || tail) ELSE sha256(head || said || tail) END AS shown
  FROM d),
low AS (
  SELECT 0 AS level, lang, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, lang, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY lang, pos // 2),
subroots AS (
  SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY pos // 2),
steps AS (
  SELECT l.doc_id, s.level, l.pos >> s.level AS place, o.node AS other
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM low WHERE n > 1) s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN low o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = s.level AND o.pos = xor(l.pos >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, r.height + s.level, r.place >> s.level, o.node
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) s
  LEFT JOIN high o ON o.level = s.level AND o.pos = xor(r.place >> s.level, 1)),
proofs AS (
  SELECT doc_id, string_agg(coalesce(other, ''), '' ORDER BY level) AS proof,
         list({'place': place, 'other': coalesce(other, '')} ORDER BY level) AS path
  FROM steps GROUP BY doc_id),
folded AS (
  SELECT l.doc_id, l.lang, l.leaf, 1 AS step, l.shown AS node, coalesce(p.proof, '') AS proof,
         coalesce(p.path, []) AS path
  FROM leaves l LEFT JOIN proofs p USING (doc_id)
  UNION ALL
  SELECT doc_id, lang, leaf, step + 1,
         sha256(CASE WHEN path[step].place % 2 = 1 THEN path[step].other || node ELSE node || path[step].other END),
         proof, path
  FROM folded WHERE step <= len(path))
SELECT f.doc_id, f.leaf, r.subroot, t.node AS root, sha256(f.proof) AS proof_sha256,
       f.node AS folded_root, f.node = t.node AS verified
FROM folded f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang
CROSS JOIN (SELECT node FROM high WHERE n = 1) t
WHERE f.step = len(f.path) + 1
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT row_no, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term
         HAVING count(DISTINCT row_no) >= 10),
vocab AS (SELECT lang, count(*) AS v, sum(lang_count)::HUGEINT AS lang_n FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS group_n FROM held GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(group_n, 0)::HUGEINT AS group_n
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 2)) // (g.group_n + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_count + 2)) // (v.lang_n + 2 * v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocab v USING (lang)
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": OP11,
    "op12_merkle_manifest": OP12,
    "op13_source_divergence": OP13,
}
