"""DuckDB statements for those queries that SQL can express."""

from __future__ import annotations

from flowlab.llm.mixing import SLOTS, UNIT
from flowlab.llm.quality import STOP_WORDS, SYMBOLS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

QUALITY = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_intersect(list_distinct(w), [{_STOP}])) AS n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•‣]\\s'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_dots
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 3 AND 10 AND n_symbols::DOUBLE / n_words <= 0.1e0 AND n_stop >= 2
       AND n_dup_lines::DOUBLE / n_lines <= 0.5e0 AND n_bullet::DOUBLE / n_lines <= 0.9e0 AND n_dots::DOUBLE / n_lines <= 0.3e0 AS kept
FROM b
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2e0 AS cap FROM s
), v AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM k WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)
), a AS (
  SELECT source, source_size, round(least(cap, weight * max(level) OVER ()), 6) AS target,
         ('0x' || substr(md5('mix|offset|' || coalesce('=' || source, '')), 1, 8))::BIGINT % {UNIT} AS u FROM v
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(round(target / source_size * {UNIT}), {2 * UNIT}) END::BIGINT AS step FROM a
), r AS (
  SELECT d.*, e.source_size, e.target, e.step, e.u, row_number() OVER (
    PARTITION BY d.source ORDER BY length(size::VARCHAR) * 100 + substr(rpad(size::VARCHAR, 2, '0'), 1, 2)::INT, digest % {SLOTS}, size, digest, doc_id
  ) - 1 AS place
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR)), 1, 8))::BIGINT AS digest FROM d) d
  JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, source, (((((place + 1) * step + u) >> 24) - ((place * step + u) >> 24)) * size)::BIGINT AS taken FROM r
"""

_SHIFTED = "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, b: {_SHIFTED}), 4294967295)"


TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, l, conv_id - (conv_id % 5 + 5) % 5 AS base_id, {crc32('conv_id::VARCHAR')} % 9 AS head FROM own
), rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(b.l[1:h.head], []), h.l[h.head + 1:]) AS l FROM h LEFT JOIN own b ON b.conv_id = h.base_id
), paths AS (
  SELECT conv_id, d AS depth, len(l) AS size, l[1:d] AS node, CASE WHEN d > 0 THEN l[1:d - 1] END AS parent, strlen(l[d].t) AS bytes
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, node
), kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY depth, parent
), full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node
), below AS (
  SELECT t.depth, t.node, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM (SELECT depth, node, unnest(range(0, depth + 1)) AS up FROM full_nodes) x JOIN full_nodes v ON v.depth = x.depth AND v.node = x.node
  JOIN full_nodes t ON t.depth = x.up AND t.node = x.node[1:x.up] GROUP BY t.depth, t.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN full_nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

SQL: dict[str, str] = {"op12_pivot_top_k": TOP_K, "op13_prefix_trie": TRIE, "op9_quality_rules": QUALITY, "op2_systematic_mixing": MIXING}
