"""SQL of queries_truth."""

from __future__ import annotations

_LINES = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice)::INTEGER AS k, l_partkey AS part, l_suppkey AS supplier,
         CAST(l_partkey % 10 + 10 AS INTEGER) AS n, CAST(l_suppkey % 9 AS INTEGER) AS high, CAST(l_partkey % 7 + l_suppkey % 3 AS INTEGER) AS shift,
         CAST(l_suppkey % 30 AS INTEGER) AS added, CAST(l_partkey % 50 AS INTEGER) AS place,
         l_returnflag || '-' || l_linestatus || ' AIR' AS mode, 'part ' || l_partkey AS note
  FROM lineitem WHERE l_orderkey % 10 <> 0
)"""

SQL: dict[str, str] = {
    "truth_blocks": f"""
WITH {_LINES}
SELECT document_id, CAST(2 - k % 2 AS BIGINT) AS page_number,
       row_number() OVER (PARTITION BY document_id, k % 2 ORDER BY k) - 1 AS source_index,
       'paragraph' AS type, repeat(chr(96 + k), n) AS text, CAST(k AS BIGINT) AS reading_order,
       CAST(10 * k AS DOUBLE) AS top, CAST(10 * k + 10 + high AS DOUBLE) AS bottom, CAST(0 AS BIGINT) AS n_cells
FROM lines
UNION ALL
SELECT document_id, 3, 0, 'table', '', 0, NULL, NULL, 2 * count(*) FROM lines GROUP BY document_id""",
    "payload_scores": f"""
WITH RECURSIVE {_LINES},
pairs AS (
  SELECT g.document_id, g.k % 2 AS side, g.k AS g, p.k AS p,
         greatest(0, least(10 * g.k + 10 + g.high, 10 * p.k + p.shift + 12) - greatest(10 * g.k, 10 * p.k + p.shift)) AS shared, 22 + g.high AS both_sides
  FROM lines g JOIN lines p ON g.document_id = p.document_id AND g.k % 2 = p.k % 2
),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, side ORDER BY shared / (both_sides - shared) DESC, g DESC, p DESC) AS nth, shared / (both_sides - shared) AS overlap
  FROM pairs WHERE shared / (both_sides - shared) >= 0.5
),
chosen AS (
  SELECT document_id, side, nth, overlap, [g] AS gs, [p] AS ps, true AS taken FROM candidates WHERE nth = 1
  UNION ALL
  SELECT c.document_id, c.side, c.nth, c.overlap, CASE WHEN f.free THEN list_append(s.gs, c.g) ELSE s.gs END, CASE WHEN f.free THEN list_append(s.ps, c.p) ELSE s.ps END, f.free
  FROM chosen s JOIN candidates c ON s.document_id = c.document_id AND s.side = c.side AND c.nth = s.nth + 1,
       LATERAL (SELECT NOT list_contains(s.gs, c.g) AND NOT list_contains(s.ps, c.p) AS free) f
),
layout AS (SELECT document_id, count(*) AS tp, avg(overlap) AS mean_iou FROM chosen WHERE taken GROUP BY document_id),
counts AS (
  SELECT document_id, count(*) AS n, sum(CASE WHEN k % 4 <> 0 THEN 2 ELSE 1 END) AS p_cells,
         sum(CASE WHEN part % 3 = 0 THEN 5 ELSE 0 END) AS changed,
         sum(length(mode) + length(note)) AS cell_length, sum(CASE WHEN k % 4 = 0 THEN length(note) ELSE 0 END) AS lost,
         array_to_string(list_sort(list(mode)), ' ') AS truth, array_to_string(list_sort(list(CASE WHEN part % 3 = 0 THEN lower(mode) ELSE mode END)), ' ') AS read
  FROM lines GROUP BY document_id
),
matched AS (SELECT *, row_number() OVER (PARTITION BY document_id, k % 2 ORDER BY place, k) AS p FROM lines WHERE 2 * n / (2 * n + added) >= 0.6),
crossed AS (SELECT a.document_id, count(*) AS x FROM matched a JOIN matched b ON a.document_id = b.document_id AND a.k % 2 = b.k % 2 AND a.p < b.p AND a.k > b.k GROUP BY a.document_id),
sums AS (
  SELECT c.*, coalesce(l.tp, 0) AS tp, l.mean_iou, coalesce(m.m, 0) AS m, coalesce(x.x, 0) AS x
  FROM counts c LEFT JOIN layout l ON c.document_id = l.document_id LEFT JOIN crossed x ON c.document_id = x.document_id
       LEFT JOIN (SELECT document_id, count(*) AS m FROM matched GROUP BY document_id) m ON c.document_id = m.document_id
)
SELECT 'r' || document_id AS run_id, round(levenshtein(truth, read) / length(truth), 6) AS text_cer, 1::DOUBLE AS page_count_accuracy,
       round(tp / n, 6) AS layout_precision_iou50, round(tp / n, 6) AS layout_recall_iou50, round(tp / n, 6) AS layout_f1_iou50, round(mean_iou, 6) AS layout_mean_iou,
       1::DOUBLE AS table_structure_precision, round(p_cells / (2 * n), 6) AS table_structure_recall,
       round(1 - (changed + lost) / cell_length, 6) AS table_content_accuracy,
       round(1 - x / nullif(m * (m - 1) / 2, 0), 6) AS reading_order_accuracy, round(m / (n + 1), 6) AS reading_order_coverage,
       tp AS layout_matches_iou50, 2 * n AS ground_truth_cells, CAST(p_cells AS BIGINT) AS prediction_cells, CAST(p_cells AS BIGINT) AS matched_cells,
       m AS reading_order_matched_blocks, x AS reading_order_inversions, n AS ground_truth_pii_entities
FROM sums""",
    "crossed_lines": """
WITH places AS (
  SELECT l_suppkey AS supplier, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS g
  FROM lineitem
)
SELECT a.supplier, any_value(n) AS n_matched, sum(crossed)::BIGINT AS n_inversions
FROM (SELECT a.supplier, a.p, count(b.p) AS crossed FROM places a LEFT JOIN places b ON a.supplier = b.supplier AND a.p < b.p AND a.g > b.g GROUP BY a.supplier, a.p) a
JOIN (SELECT supplier, count(*) AS n FROM places GROUP BY supplier) s ON a.supplier = s.supplier
GROUP BY a.supplier""",
    "part_name_distances": """
WITH RECURSIVE pairs AS (
  SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
),
steps AS (
  SELECT p_partkey, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS longest FROM pairs
  UNION ALL
  SELECT p_partkey, x, y, i + 1,
         list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda h: CASE WHEN h > 0 AND substr(x, i + 1, 1) = substr(y, h, 1) THEN longest[h] + 1 ELSE longest[h + 1] END)))
  FROM steps WHERE i < length(x)
)
SELECT p_partkey, levenshtein(x, y) AS levenshtein, length(x) + length(y) - 2 * longest[length(y) + 1] AS indel, true AS gaps_between
FROM steps WHERE i = length(x)""",
    "streamed_scores": r"""
WITH texts AS (SELECT conv_id || '-' || turn AS id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations)
SELECT 'r' || id AS run_id, id AS document_id, 2::BIGINT AS run_version, length(text) - length(replace(text, 'a', '')) AS text_edit_distance, length(text) AS ground_truth_characters FROM texts""",
}
