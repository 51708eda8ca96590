"""The queries of docgauge.queries_results in SQL (DuckDB)."""

from __future__ import annotations



_DOCS = r"""
docs AS (
  SELECT doc_id, source, lang, text, split_part(text, chr(10), 1) AS head,
         CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS rest
  FROM (SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text FROM documents)
)"""

#: White space that Python's split() takes, as RE2 writes it.
_WHITE = r"[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _distance(a: str, b: str) -> str:
    """Levenshtein distance in code points: each different character of a pair becomes one byte (for up to 127 of them)."""
    coded = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(CAST(list_position(list_distinct(string_split({a} || {b}, '')), c) AS INTEGER))), '')"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN {a} = '' OR {b} = '' THEN length({a} || {b}) ELSE levenshtein({coded(a)}, {coded(b)}) END"


_TURNS = rf"""
turns AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{_WHITE}+', ' ', 'g'), ' ') AS text FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.text AS r, b.text AS p FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
texts AS (SELECT *, {_distance("r", "p")} AS d FROM pairs)"""

_RUNS = """
runs AS (
  SELECT event_id AS e, CAST(user_id AS VARCHAR) AS experiment_id, '=parser' || event_id % 4 AS parser_name, event_id % 900 AS latency_ms, ts,
         ['SUCCEEDED', 'RUNNING', 'FAILED', 'SUCCEEDED', 'PENDING'][event_id % 5 + 1] AS parse,
         ['NOT_REQUESTED', 'FAILED', 'RUNNING', 'SUCCEEDED', 'INTERRUPTED', 'PENDING', 'SUCCEEDED'][event_id % 7 + 1] AS deid
  FROM events
)"""

_CONDITIONS = "(VALUES ('baseline'), ('no_op'), ('A'), ('B'), ('AB')) c(condition)"


def _counts(rules: dict[str, str], rows: str) -> str:
    """rule, n for the rules that fire; rules: what to count in rows."""
    one = [f"SELECT '{name}' AS rule, CAST(({what}) AS BIGINT) AS n FROM {rows}" for name, what in rules.items()]
    return "SELECT rule, n FROM (" + " UNION ALL ".join(one) + ") WHERE n > 0"


def _mod(n: int, by: int, name: str = "doc_id") -> str:
    return f"count(*) FILTER ({name} % {by} = {n})".replace("FILTER (", "FILTER (WHERE ")


SQL: dict[str, str] = {
    "whole_text_scores": rf"""
WITH {_TURNS}
SELECT conv_id, turn, CAST(d AS BIGINT) AS text_edit_distance,
       round(CASE WHEN length(r) > 0 THEN d / length(r) WHEN length(p) = 0 THEN 0.0 ELSE 1.0 END, 6) AS text_cer,
       round(greatest(0.0, 1 - d / greatest(length(r), length(p), 1)), 6) AS text_accuracy, CAST(r = p AS INTEGER)::DOUBLE AS text_exact_match
FROM texts""",
    "tree_results": f"""
WITH {_DOCS}
SELECT doc_id, CAST(1 AS BIGINT) AS page_number, 'p1-b1' AS block_id, 'title' AS type, CAST(0 AS BIGINT) AS reading_order, md5(trim(head, E' \\t\\n\\r')) AS text_md5 FROM docs
UNION ALL
SELECT doc_id, 3, 'own', 'unknown', 1, md5(array_to_string(list_filter([trim(lang), regexp_replace(rest, '^{_WHITE}+|{_WHITE}+$', '', 'g')], lambda x: x <> ''), chr(10))) FROM docs""",
    "pipeline_results": f"""
WITH {_DOCS}, shapes AS (FROM (VALUES (1, 'title', 7), (2, 'table', 3), (3, 'unknown', 9)) s(i, type, reading_order))
SELECT doc_id, CAST(5 AS BIGINT) AS page_number, 'p5-b' || i AS block_id, type, CAST(reading_order AS BIGINT) AS reading_order,
       md5([head, rest, source][i]) AS text_md5, CASE WHEN i = 2 THEN '<t>' || lang || '</t>' END AS html, CAST(20 AS DOUBLE) AS bottom
FROM docs, shapes""",
    "content_list_results": f"""
WITH {_DOCS}, shapes AS (FROM (VALUES (1, 'paragraph', 2), (2, 'table', 1), (3, 'formula', 2)) s(i, type, page_number))
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, 'mineru-block-' || i AS block_id, type, CAST(i - 1 AS BIGINT) AS reading_order, md5(trim([head, rest, source][i], ' ')) AS text_md5
FROM docs, shapes""",
    "plain_results": rf"""
WITH {_DOCS}
SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 4 = 2 THEN md5(head) END AS markdown_md5,
       CAST(len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n_blocks
FROM docs""",
    "vendor_masks": """
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 7 END AS detected,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN doc_id % 7 WHEN 2 THEN 2 END AS masked, ['m', 'd', '', NULL][doc_id % 4 + 1] AS text
FROM documents""",
    "evaluation_scores": rf"""
WITH {_TURNS},
base AS (
  SELECT *, CAST(conv_id AS BIGINT) AS c, CAST(turn AS BIGINT) AS t, conv_id % 5 <> 0 AS whole FROM texts
),
shapes AS (
  SELECT *, greatest(0, 100 - c % 120) / (100 + c % 120) AS iou_title, least(20, c % 40 + 10) / greatest(20, c % 40 + 10) AS iou_text,
         'cell ' || c * 7 AS cell_g, 'cell ' || c * 9 AS cell_p, 'x_' || t AS f_g, 'x_' || t + 9 AS f_p,
         CASE WHEN t % 2 = 0 THEN 2 ELSE 0 END AS n_pii, CASE WHEN t % 2 = 0 THEN CASE WHEN c % 3 = 0 THEN 1 ELSE 2 END ELSE 0 END AS tp_pii
  FROM base
),
sums AS (
  SELECT *, CAST(iou_title >= 0.5 AS INTEGER) + CAST(iou_text >= 0.5 AS INTEGER) AS tp,
         CASE WHEN iou_title >= 0.5 THEN iou_title ELSE 0 END + CASE WHEN iou_text >= 0.5 THEN iou_text ELSE 0 END AS iou_sum,
         levenshtein(cell_g, cell_p) AS d_cell, greatest(length(cell_g), length(cell_p)) AS n_cell, levenshtein(f_g, f_p) AS d_formula, greatest(length(f_g), length(f_p)) AS n_formula,
         2 AS n_boxes
  FROM shapes
),
scored AS (
  SELECT c, t, conv_id, turn, d, whole, tp, tp_pii, n_pii,
         CASE WHEN length(r) > 0 THEN d / length(r) WHEN length(p) = 0 THEN 0.0 ELSE 1.0 END AS text_cer,
         greatest(0.0, 1 - d / greatest(length(r), length(p), 1)) AS text_accuracy, CASE WHEN r = p THEN 1.0 ELSE 0.0 END AS text_exact_match,
         CASE WHEN whole THEN 1.0 ELSE 0.5 END AS page_count_accuracy,
         tp / 2 AS layout, CASE WHEN tp > 0 THEN iou_sum / tp END AS layout_mean_iou,
         CASE WHEN whole THEN 1.0 ELSE 0.0 END AS table_count_accuracy,
         CASE WHEN whole THEN 1 - d_cell / n_cell / 3 ELSE 0.0 END AS table_teds, CASE WHEN whole THEN 1.0 ELSE 0.0 END AS table_structure,
         CASE WHEN whole THEN 1 - d_cell / n_cell ELSE 0.0 END AS table_content_accuracy,
         CASE WHEN whole THEN CASE WHEN t % 2 = 1 THEN 1 - 1 / 3 ELSE 1.0 END ELSE CASE WHEN t % 2 = 1 THEN 0.0 ELSE 1.0 END END AS reading_order_accuracy,
         CASE WHEN whole THEN 3 / 4 ELSE 2 / 4 END AS reading_order_coverage,
         CASE WHEN whole THEN 1 - d_formula / n_formula ELSE 0.0 END AS formula_accuracy,
         tp_pii / nullif(n_pii, 0) AS pii_recall, tp_pii / 2 AS pii_precision
  FROM sums
)
SELECT conv_id || '-' || turn AS run_id, round(text_cer, 6) AS text_cer, round(text_accuracy, 6) AS text_accuracy, text_exact_match::DOUBLE AS text_exact_match, page_count_accuracy::DOUBLE AS page_count_accuracy,
       layout AS layout_precision_iou50, layout AS layout_recall_iou50, layout AS layout_f1_iou50, round(layout_mean_iou, 6) AS layout_mean_iou,
       table_count_accuracy::DOUBLE AS table_count_accuracy, round(table_teds::DOUBLE, 6) AS table_teds, table_structure::DOUBLE AS table_teds_structure,
       CASE WHEN whole THEN 1::DOUBLE END AS table_structure_precision, table_structure::DOUBLE AS table_structure_recall, table_structure::DOUBLE AS table_structure_f1, round(table_content_accuracy::DOUBLE, 6) AS table_content_accuracy,
       round(reading_order_accuracy::DOUBLE, 6) AS reading_order_accuracy, reading_order_coverage, round(formula_accuracy::DOUBLE, 6) AS formula_accuracy, 0::DOUBLE AS formula_exact_match,
       pii_precision, pii_recall, CASE WHEN pii_recall IS NULL THEN 0::DOUBLE ELSE round(2 * pii_precision * pii_recall / (pii_precision + pii_recall), 6) END AS pii_f1,
       1 - pii_recall AS pii_leakage_rate, 1 - pii_precision AS pii_overmask_rate,
       round((text_accuracy + layout + table_teds + reading_order_accuracy + formula_accuracy + CASE WHEN pii_recall IS NULL THEN 0 ELSE 2 * pii_precision * pii_recall / (pii_precision + pii_recall) END) / 6, 6) AS overall_quality,
       CAST(d AS BIGINT) AS text_edit_distance, CAST(2 AS BIGINT) AS ground_truth_pages, CAST(CASE WHEN whole THEN 2 ELSE 1 END AS BIGINT) AS prediction_pages, CAST(tp AS BIGINT) AS layout_matches_iou50,
       CAST(whole AS BIGINT) AS matched_table_pairs, CAST(whole AS BIGINT) AS matched_cells, CAST(CASE WHEN whole THEN 3 ELSE 2 END AS BIGINT) AS reading_order_matched_blocks, t % 2 AS reading_order_inversions,
       CAST(1 AS BIGINT) AS ground_truth_formulas, CAST(tp_pii AS BIGINT) AS matched_pii_entities
FROM scored""",
    "ground_truth_gate": _counts(
        {
            "payload_not_object": _mod(1, 9), "full_text_not_string": _mod(1, 9) + " + " + _mod(2, 9), "pages_not_array": _mod(1, 9) + " + " + _mod(2, 9),
            "page_number_not_positive": _mod(3, 9), "page_number_not_integer": _mod(3, 9), "page_without_blocks_array": _mod(3, 9), "block_not_object": _mod(4, 9), "block_type_or_text_not_string": _mod(4, 9),
            "reading_order_not_integer": _mod(4, 9), "cells_not_array": _mod(5, 9), "cell_not_object": _mod(5, 9), "cell_coordinates_not_integer": _mod(5, 9),
            "entity_offsets_out_of_order": _mod(6, 9), "entity_without_type_or_offsets": _mod(7, 9), "entities_not_array": _mod(8, 9),
        },
        "documents",
    ),
    "case_gate": _counts(
        {
            "page_number_not_positive": _mod(1, 11), "unknown_source_kind": _mod(2, 11), "repeated_block_id": _mod(3, 11), "not_exactly_a_and_b": _mod(3, 11),
            "several_documents": _mod(4, 11), "question_of_other_document": f"{_mod(4, 11)} + {_mod(5, 11)}", "repeated_question_id": _mod(6, 11), "overlapping_repairs": _mod(7, 11),
            "offsets_outside_block": _mod(8, 11), "before_text_differs": _mod(9, 11), "source_note_missing": f"2 * {_mod(10, 11)}",
        },
        "documents",
    ),
    "answer_gate": _counts(
        {
            "missing": _mod(0, 5, "o_orderkey"), "blank_answer": "count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0)",
            "unknown_evidence": "count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0)", "payload_document_without_blocks": _mod(0, 13, "o_orderkey"),
        },
        "orders",
    ),
    "block_gate": """
WITH blocks AS (SELECT l_orderkey AS o, l_suppkey % 2 AS page, l_partkey % 2 AS own, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'b' || l_linenumber % 4 END AS id FROM lineitem)
SELECT 'page_number_differs' AS rule, count(*) AS n FROM blocks WHERE page <> own
UNION ALL SELECT 'id_missing', count(*) FROM blocks WHERE id = ''
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT o, id FROM blocks GROUP BY o, id HAVING count(*) > 1)""",
    "run_gate": """
WITH records AS (
  SELECT CAST(user_id % 20 AS VARCHAR) AS case_id, event_id % 3 + 1 AS repeat_id, ['A', 'B', 'C'][user_id % 3 + 1] AS condition, event_id // 2 AS execution_id, event_id % 17 = 0 AS changed FROM events
),
grid AS (SELECT CAST(x AS VARCHAR) AS case_id, repeat_id, condition FROM range(25) r(x), (VALUES (1), (2)) s(repeat_id), (VALUES ('A'), ('B')) c(condition)),
found AS (
  SELECT 'missing' AS rule, count(*) AS n FROM grid g ANTI JOIN records r USING (case_id, repeat_id, condition)
  UNION ALL SELECT 'unexpected', count(*) FROM (SELECT DISTINCT case_id, repeat_id, condition FROM records) r ANTI JOIN grid g USING (case_id, repeat_id, condition)
  UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM records GROUP BY case_id, repeat_id, condition HAVING count(*) > 1)
  UNION ALL SELECT 'repeated_execution_id', count(*) FROM records WHERE execution_id IN (SELECT execution_id FROM records GROUP BY execution_id HAVING count(*) > 1)
  UNION ALL SELECT 'input_changed', count(*) FROM records WHERE changed
)
SELECT rule, n FROM found WHERE n > 0""",
    "judgment_gate": """
WITH j AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END || doc_id AS judgment_id FROM labels),
found AS (
  SELECT 'missing' AS rule, count(*) AS n FROM documents d WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT judgment_id FROM j)
  UNION ALL SELECT 'unexpected', count(DISTINCT judgment_id) FROM j WHERE judgment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
  UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM j GROUP BY judgment_id HAVING count(*) > 1)
  UNION ALL SELECT 'label_missing', count(*) FROM j WHERE doc_id % 4 = 0
  UNION ALL SELECT 'judge_missing', count(*) FROM j WHERE doc_id % 6 = 0
  UNION ALL SELECT 'text_score_out_of_range', count(*) FROM j WHERE doc_id % 7 NOT BETWEEN 1 AND 5
  UNION ALL SELECT 'table_score_out_of_range', count(*) FROM j WHERE doc_id % 6 = 0
  UNION ALL SELECT 'notes_too_long', count(*) FROM j WHERE doc_id % 5000 > 4000
)
SELECT rule, n FROM found WHERE n > 0""",
    "experiment_gate": """
WITH counted AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id % 40) AS d FROM events GROUP BY user_id),
found AS (
  SELECT 'parser_repeated' AS rule, count(*) AS n FROM counted WHERE n <> d
  UNION ALL SELECT 'run_count', count(*) FROM counted WHERE n NOT BETWEEN 1 AND 8
  UNION ALL SELECT 'format_not_supported', count(*) FROM events WHERE event_id % 3 = 2
  UNION ALL SELECT 'conflict', count(*) FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0
  UNION ALL SELECT 'missing', count(*) FROM events WHERE event_id % 4 = 0 AND event_id % 3 = 0
)
SELECT rule, n FROM found WHERE n > 0""",
    "judged_answers": f"""
WITH answers AS (SELECT source AS case_id, condition, (doc_id + length(condition)) % 3 <> 0 AS correct, (doc_id + 8) % 3 <> 0 AS base FROM documents, {_CONDITIONS})
SELECT case_id, condition, count(*) FILTER (WHERE correct) AS correct_count, count(*) AS question_count, count(*) FILTER (WHERE correct AND NOT base) AS n_recovered,
       count(*) FILTER (WHERE base AND NOT correct) AS n_regressed, count(*) FILTER (WHERE correct) - count(*) FILTER (WHERE base) AS net_recovery
FROM answers GROUP BY case_id, condition""",
    "judgment_ids": f"""
WITH {_DOCS}
SELECT doc_id, sha256('{{"c0":"' || source || '","c1":"' || doc_id || '"}}') AS judgment_id,
       CASE WHEN (length(text) - length(replace(text, 'the ', ''))) = 4 THEN strpos(text, 'the ') - 1 END AS place
FROM docs""",
    "cited_evidence": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN CASE WHEN o_orderkey % 4 = 3 THEN 'evidence_not_retrieved' END WHEN 2 THEN 'not_json' WHEN 3 THEN 'answer_missing' WHEN 4 THEN 'evidence_not_strings' WHEN 5 THEN 'other_keys' END AS rule,
       CASE WHEN o_orderkey % 6 = 0 THEN CASE o_orderkey % 3 WHEN 1 THEN 'b1,b9' ELSE 'b' || o_orderkey % 3 || ',b9,b1' END
            WHEN o_orderkey % 6 = 1 AND o_orderkey % 4 <> 3 THEN 'b' || o_orderkey % 4 || ',b9' END AS blocks
FROM orders""",
    "cited_marks": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'b1,b2,b3' WHEN o_orderkey % 5 IN (2, 3) THEN 'b' || o_orderkey % 5 || ',b1' ELSE 'b1' END AS sources,
       CASE WHEN o_orderkey % 2 = 1 THEN 'batch_fallback' ELSE 'explicit_markers' END AS lineage_mode
FROM orders""",
    "run_board": f"""
WITH {_RUNS}
SELECT round(100 * count(*) FILTER (WHERE parse = 'SUCCEEDED') / nullif(count(*) FILTER (WHERE parse IN ('SUCCEEDED', 'FAILED')), 0), 6) AS success_rate, round(avg(latency_ms), 6) AS average_latency_ms,
       count(*) FILTER (WHERE parse IN ('PENDING', 'RUNNING')) AS active_runs, count(*) FILTER (WHERE parse = 'FAILED') AS failed_runs
FROM runs""",
    "deidentified_statuses": f"""
WITH {_RUNS},
counted AS (
  SELECT experiment_id, count(*) AS n, count(*) FILTER (WHERE parse = 'PENDING') AS pending, count(*) FILTER (WHERE parse IN ('PENDING', 'RUNNING')) AS unfinished, count(*) FILTER (WHERE parse = 'SUCCEEDED') AS done,
         count(*) FILTER (WHERE parse = 'SUCCEEDED' AND deid IN ('PENDING', 'RUNNING')) AS deid_open, count(*) FILTER (WHERE parse = 'SUCCEEDED' AND deid IN ('FAILED', 'INTERRUPTED')) AS deid_failed,
         count(*) FILTER (WHERE parse = 'FAILED' OR (parse = 'SUCCEEDED' AND deid IN ('FAILED', 'INTERRUPTED') AND e % 2 <> 0)) AS retry_parse
  FROM runs GROUP BY experiment_id
)
SELECT c.experiment_id, round(100 * (n - unfinished) / n, 6) AS progress,
       CASE WHEN pending = n THEN 'PENDING' WHEN unfinished > 0 THEN 'RUNNING' WHEN done = 0 THEN 'FAILED' WHEN deid_open > 0 THEN 'RUNNING' WHEN done <> n OR deid_failed > 0 THEN 'PARTIALLY_COMPLETED' ELSE 'COMPLETED' END AS status,
       count(*) FILTER (WHERE parse = 'RUNNING' OR (parse = 'SUCCEEDED' AND deid IN ('PENDING', 'RUNNING'))) AS shown_running, any_value(retry_parse) AS retry_parse,
       count(*) FILTER (WHERE parse = 'SUCCEEDED' AND deid IN ('FAILED', 'INTERRUPTED') AND e % 2 = 0) AS retry_deidentification
FROM counted c JOIN runs r ON c.experiment_id = r.experiment_id GROUP BY ALL""",
    "preferred_runs": f"""
WITH {_RUNS}
SELECT experiment_id, CAST(e % 2 AS VARCHAR) AS evaluator_id, CAST(e AS VARCHAR) AS run_id FROM runs WHERE e % 3 = 0
QUALIFY row_number() OVER (PARTITION BY experiment_id, e % 2 ORDER BY ts DESC, CAST(e AS VARCHAR)) = 1""",
    "side_by_side": f"""
WITH {_RUNS}
SELECT CAST(e AS VARCHAR) AS run_id, '''' || parser_name AS parser_name, latency_ms, CASE WHEN e % 3 <> 0 THEN e % 9 END AS page_count, CASE WHEN e % 3 <> 0 THEN e + e % 10 ELSE 0 END AS result_size_bytes,
       CASE WHEN e % 4 = 0 THEN e % 5 END AS detected_entity_count, CASE WHEN e % 2 = 0 AND e % 6 <> 0 THEN e % 5 + 1 END AS text_score, e % 2 = 0 AND e % 6 <> 0 AND e % 10 = 0 AS is_preferred,
       CASE WHEN e % 2 = 0 AND e % 6 <> 0 THEN '''-note' END AS notes
FROM runs""",
    "blank_pages": r"""
WITH pages AS (
  SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS place FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || ' ' || chr(10)), chr(10)) AS parts FROM documents)
)
SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (WHERE trim(text, ' ') <> '')) AS text_md5,
       string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE trim(text, ' ') = '') AS empty_pages
FROM pages GROUP BY doc_id HAVING count(*) FILTER (WHERE trim(text, ' ') <> '') > 0""",
    "table_rows": """
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(r AS BIGINT) AS "row", CASE WHEN r = 0 THEN '1:1:' || source ELSE doc_id % 3 || ':1:' || lang END AS cells
FROM documents, (VALUES (0), (1)) o(ordinal), (VALUES (0), (1)) s(r)""",
    "recomputed": f"""
WITH {_RUNS}
SELECT parser_name, count(*) FILTER (WHERE e % 3 = 0) AS evaluated, count(*) FILTER (WHERE e % 3 <> 0) AS skipped FROM runs WHERE parse = 'SUCCEEDED' GROUP BY parser_name""",
    "token_counts_of_answers": """
SELECT o_orderpriority, count(*) AS calls, CAST(sum(o_orderkey % 100) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(o_orderkey % 11) AS BIGINT) AS total_tokens
FROM orders GROUP BY o_orderpriority""",
}
