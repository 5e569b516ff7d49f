"""Plain SQL for the queries of this subpackage, where SQL can say them."""

OP1 = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, n, [line, lead(line) OVER d, lead(line, 2) OVER d] AS w, lead(n, 2) OVER d AS last
  FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY n)
), later AS (
  SELECT doc_id, n FROM windows WHERE last IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, n) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest([n, n + 1, n + 2]) AS n FROM later
), marked AS (
  SELECT l.doc_id, l.line, l.place, x.n IS NOT NULL AS has_word, c.n IS NOT NULL AS gone
  FROM lines l LEFT JOIN numbered x ON l.doc_id = x.doc_id AND l.place = x.place
  LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.n = x.n
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
    count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
  coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP8 = """
SELECT doc_id,
  max(doc_id) OVER g AS keep_id,
  count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, coalesce(sum(2 * source_size) OVER p, 0)::BIGINT AS full_before, coalesce(sum(w) OVER p, 0)::BIGINT AS w_before,
    (sum(source_size) OVER () * 3)::BIGINT / 2.0::DOUBLE AS budget, (sum(w) OVER ())::BIGINT AS w_all
  FROM sources
  WINDOW p AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (budget - full_before) / (w_all - w_before)::DOUBLE AS lvl FROM ordered
), aimed AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE,
    coalesce(w * (SELECT lvl FROM levels WHERE w * lvl < 2 * source_size ORDER BY (2 * source_size)::DOUBLE / w, source NULLS FIRST LIMIT 1), (2 * source_size)::DOUBLE)) AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aimed
), rests AS (
  SELECT *, target - whole * source_size AS rest FROM budgets
), sums AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
    sum(size) OVER (PARTITION BY s.source, h)::BIGINT AS peers
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - peers <= rest AND upto - rest < rest - (upto - peers)))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums
"""

OP11 = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), masked AS (
  SELECT doc_id, part,
    [len(words) < 100,
     100 * len(list_distinct(words)) < 80 * len(words),
     100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * len(body),
     regexp_matches(body, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
  FROM worded
), told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masked LEFT JOIN told USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 3, 4, 5]) AS place
), orders AS (
  SELECT [a.place, b.place, c.place, d.place, e.place] AS filters, a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM letters a JOIN letters b ON b.place <> a.place JOIN letters c ON c.place NOT IN (a.place, b.place)
  JOIN letters d ON d.place NOT IN (a.place, b.place, c.place) JOIN letters e ON e.place NOT IN (a.place, b.place, c.place, d.place)
), steps AS (
  SELECT filters, filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), judged AS (
  SELECT part, filter_order, step, filters[step] AS own, n, good, toxic,
    fails[filters[step]] AS failed,
    len(list_filter(filters[:step - 1], lambda f: fails[f])) > 0 AS gone,
    len(list_filter(fails, lambda f: f)) AS n_fails
  FROM counted, steps
), reported AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM reported
"""

OP13 = """
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM paid
"""

# The head of a conversation follows the CRC-32 of its id's digits, bit by bit.
OP12 = """
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, i: xor(x >> 1::BIGINT, 3988292384::BIGINT * (x & 1::BIGINT)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ranked)
), rebuilt AS (
  SELECT i.conv_id, 0 AS own, r.pos, r.role, r.text FROM ids i JOIN ranked r ON r.conv_id = i.source AND r.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1, r.pos, r.role, r.text FROM ids i JOIN ranked r ON r.conv_id = i.conv_id AND r.pos > i.h
), sequences AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, pos) AS s FROM rebuilt GROUP BY conv_id
), members AS (
  SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s
  FROM (SELECT i.conv_id, coalesce(s, []) AS s FROM ids i LEFT JOIN sequences q ON q.conv_id = i.conv_id)
), nodes AS (
  SELECT s[:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY s[:depth], depth
), weighed AS (
  SELECT c.*, u.conv_id AS parent_conv_id, count(k.p) AS n_children,
    CASE WHEN c.depth > 0 THEN (c.n_convs - 1) * len(c.p[-1].text) ELSE 0 END AS saved
  FROM nodes c LEFT JOIN nodes u ON u.depth = c.depth - 1 AND u.p = c.p[:c.depth - 1]
  LEFT JOIN nodes k ON k.depth = c.depth + 1 AND k.p[:c.depth] = c.p
  GROUP BY ALL
), above AS (
  SELECT p[:up] AS p, up AS depth, saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(depth + 1)) AS up FROM weighed)
), subtrees AS (
  SELECT p, depth, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM above GROUP BY p, depth
)
SELECT conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM weighed w JOIN subtrees t ON t.p = w.p AND t.depth = w.depth
"""

ORACLES = {"op1_line_dedup": OP1, "op8_exact_dedup": OP8, "op10_source_mixing": OP10, "op11_filter_audit": OP11, "op12_prefix_trie": OP12, "op13_warc": OP13}
