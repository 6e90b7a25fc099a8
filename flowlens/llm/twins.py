"""SQL of the operators that SQL can express, for another engine over the same tables."""

from __future__ import annotations

# crc32 of the digits of a number, bit by bit.
CRC = ("xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), "
       "lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT FOR i IN range(8)], "
       "lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)")
# Levels of the trees that the SQL builds: up to 16 ** 4 leaves a source.
LEVELS = 5


def field(c: str) -> str:
    """A leaf's part for one column."""
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def levels(base: str, by: str, n: int) -> str:
    """CTEs of the levels of a tree, one above the other, and of all its nodes."""
    out = [f"{base}0 AS (SELECT *, 0 AS level FROM {base})"]
    for i in range(1, n):
        out.append(f"{base}{i} AS (SELECT {by}, pos // 16 AS pos, ceil(any_value(width) / 16)::BIGINT AS width, "
                   f"sha256(string_agg(h, '' ORDER BY pos)) AS h, {i} AS level FROM {base}{i-1} WHERE width > 1 GROUP BY {by}, pos // 16)")
    out.append(f"{base}_all AS ({' UNION ALL '.join(f'SELECT {by}, pos, width, h, level FROM {base}{i}' for i in range(n))})")
    return ",\n".join(out)


MERKLE_MANIFEST = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source IS NOT NULL AS has, coalesce(source, '') AS g, text,
         {field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} AS head FROM documents),
d AS (SELECT *, sha256(head || {field('text')}) AS leaf,
             CASE WHEN {CRC.format('doc_id')} % 5 = 0
                  THEN sha256(head || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY has, g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY has, g) AS width, row_number() OVER () AS id FROM d),
n AS (SELECT has, g, pos, width, leaf AS h FROM r),
{levels('n', 'has, g', LEVELS)},
s AS (SELECT 0 AS one, has, g, row_number() OVER (ORDER BY has, encode(g)) - 1 AS pos, count(*) OVER () AS width, h
      FROM n_all WHERE width = 1),
{levels('s', 'one', 4)},
steps AS (
  SELECT id, n_all.level AS level, n_all.pos AS pos, n_all.h AS h, n_all.pos = r.pos // (16 ** n_all.level)::BIGINT AS own
  FROM r JOIN n_all ON n_all.has = r.has AND n_all.g = r.g AND n_all.width > 1
   AND n_all.pos // 16 = r.pos // (16 ** (n_all.level + 1))::BIGINT
  UNION ALL
  SELECT id, {LEVELS} + s_all.level, s_all.pos, s_all.h, s_all.pos = s.pos // (16 ** s_all.level)::BIGINT
  FROM r JOIN s ON s.has = r.has AND s.g = r.g JOIN s_all ON s_all.width > 1
   AND s_all.pos // 16 = s.pos // (16 ** (s_all.level + 1))::BIGINT),
runs AS (
  SELECT id, level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT own AND pos < ord), '') AS l,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT own AND pos > ord), '') AS r,
         row_number() OVER (PARTITION BY id ORDER BY level) AS i
  FROM (SELECT *, max(pos) FILTER (WHERE own) OVER (PARTITION BY id, level) AS ord FROM steps) GROUP BY id, level),
fold AS (
  SELECT id, 1 AS i, coalesce(other, leaf) AS h FROM r
  UNION ALL SELECT fold.id, fold.i + 1, sha256(runs.l || fold.h || runs.r) FROM fold JOIN runs ON runs.id = fold.id AND runs.i = fold.i),
proof AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY level)) AS p FROM runs GROUP BY id),
top AS (SELECT id, arg_max(h, i) AS h FROM fold GROUP BY id)
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, top.h AS folded_root, top.h = t.h AS verified
FROM r JOIN s ON s.has = r.has AND s.g = r.g JOIN top ON top.id = r.id LEFT JOIN proof p ON p.id = r.id,
     (SELECT h FROM s_all WHERE width = 1) t
"""

PREFIX_TRIE = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS ord, d, b
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
               strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS lender, ({CRC.format('conv_id')} % 9)::BIGINT AS h FROM o GROUP BY conv_id),
t AS (SELECT c.conv_id, o.ord, o.d, o.b FROM c JOIN o ON o.conv_id = c.lender AND o.ord < c.h
      UNION ALL
      SELECT c.conv_id, o.ord - c.h + least(c.h, coalesce(l.n, 0)), o.d, o.b
      FROM c JOIN o ON o.conv_id = c.conv_id AND o.ord >= c.h LEFT JOIN c l ON l.conv_id = c.lender),
s AS (SELECT c.conv_id, coalesce(ds, []) AS ds, coalesce(bs, []) AS bs FROM c LEFT JOIN (
        SELECT conv_id, list(d ORDER BY ord) AS ds, list(b ORDER BY ord) AS bs FROM t GROUP BY conv_id) x ON x.conv_id = c.conv_id),
p AS (SELECT conv_id, depth, len(ds) AS n, array_to_string(ds[1:depth], '') AS path, CASE WHEN depth = 0 THEN 0 ELSE bs[depth] END AS b
      FROM (SELECT *, unnest(range(len(ds) + 1)) AS depth FROM s)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
                 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM p GROUP BY path, depth),
kids AS (SELECT substring(path, 1, 64 * (depth - 1)) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path AND kids.depth = nodes.depth),
sub AS (SELECT v.path, v.depth, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.b)::BIGINT AS saved
        FROM v JOIN v u ON u.depth >= v.depth AND starts_with(u.path, v.path) GROUP BY v.path, v.depth)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, sub.n_leaves, sub.saved AS saved_tokens,
       sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN sub ON sub.path = v.path AND sub.depth = v.depth
LEFT JOIN nodes up ON up.depth = v.depth - 1 AND up.path = substring(v.path, 1, 64 * (v.depth - 1))
"""


def words(c: str) -> str:
    """Words of a text, A-Z in lower case."""
    return (f"coalesce(regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])")


SUFFIX_DECONTAMINATION = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words('text')} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS id, {words('text')} AS w FROM documents),
p AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
o AS (SELECT p.id, p.j, k.k, array_to_string(p.w[p.j:p.j + k.k - 1], ' ') AS win
      FROM p JOIN (SELECT DISTINCT k FROM v) k ON p.j + k.k - 1 <= len(p.w)),
m AS (SELECT o.id, o.j, o.k, v.item FROM o JOIN v ON v.win = o.win AND v.k = o.k),
h AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT DISTINCT id, unnest(range(j, j + k)) AS q FROM m) GROUP BY id),
t AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT id, item FROM m) GROUP BY id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.id = d.id LEFT JOIN t ON t.id = d.id
"""
