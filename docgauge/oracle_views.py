"""SQL of queries_views, and of queries whose recursion SQL can follow."""

from __future__ import annotations

#: Segments of 1000 characters, each with what it counts in a batch of 4000.
_SEGMENTS = """
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
segments AS (
  SELECT doc_id, text[nth * 1000 + 1:nth * 1000 + 1000] AS segment, nth, least((nth + 1) * 1000, length(text)) AS upto
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000) AS BIGINT)))) AS nth FROM texts)
),
packed AS (
  SELECT doc_id, nth, 0::BIGINT AS batch, length(segment) + 180 + length(CAST(doc_id AS VARCHAR)) AS held FROM segments WHERE nth = 0
  UNION ALL
  SELECT s.doc_id, s.nth, p.batch + CASE WHEN p.held + x.size > 4000 THEN 1 ELSE 0 END, CASE WHEN p.held + x.size > 4000 THEN x.size ELSE p.held + x.size END
  FROM packed p JOIN segments s ON s.doc_id = p.doc_id AND s.nth = p.nth + 1, LATERAL (SELECT length(s.segment) + 180 + length(CAST(s.doc_id AS VARCHAR)) AS size) x
)"""

_FILES = """
files AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) || ['.PDF', '.md', '.txt', '.exe', ''][doc_id % 5 + 1] AS name,
         'runs/' || CAST(doc_id // 10 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || ['.PDF', '.md', '.txt', '.exe', ''][doc_id % 5 + 1] AS path
  FROM documents
)"""

SQL: dict[str, str] = {
    "synthesis_batches": f"""
WITH RECURSIVE {_SEGMENTS}
SELECT p.doc_id, p.batch, count(*) AS n_segments, CAST(sum(length(s.segment)) AS BIGINT) AS n_chars
FROM packed p JOIN segments s ON p.doc_id = s.doc_id AND p.nth = s.nth GROUP BY p.doc_id, p.batch""",
    "inputs_of_batches": f"""
WITH RECURSIVE {_SEGMENTS}
SELECT p.doc_id, p.batch, md5(string_agg('SOURCE {{"block_id":"' || p.doc_id || '","text_start":' || p.nth * 1000 || ',"text_end":' || s.upto || '}}' || chr(10) || s.segment, chr(10) || chr(10) ORDER BY p.nth)) AS input_md5
FROM packed p JOIN segments s ON p.doc_id = s.doc_id AND p.nth = s.nth GROUP BY p.doc_id, p.batch""",
    "overlapping_chunks": """
WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
places AS (
  SELECT t.doc_id, 0 AS chunk_at, 0::BIGINT AS first, e.last
  FROM texts t, LATERAL (SELECT CASE WHEN length(t.text) <= 5000 THEN length(t.text)
                                     WHEN instr(reverse(t.text[1:5000]), chr(10)) BETWEEN 1 AND 2500 THEN 5000 - instr(reverse(t.text[1:5000]), chr(10)) ELSE 5000 END AS last) e
  UNION ALL
  SELECT t.doc_id, p.chunk_at + 1, b.first, e.last
  FROM places p JOIN texts t ON p.doc_id = t.doc_id, LATERAL (SELECT greatest(p.last - 400, p.first + 1) AS first) b,
       LATERAL (SELECT CASE WHEN length(t.text) <= b.first + 5000 THEN length(t.text)
                            WHEN instr(reverse(t.text[b.first + 1:b.first + 5000]), chr(10)) BETWEEN 1 AND 2500 THEN b.first + 5000 - instr(reverse(t.text[b.first + 1:b.first + 5000]), chr(10))
                            ELSE b.first + 5000 END AS last) e
  WHERE p.last < length(t.text)
)
SELECT p.doc_id, p.chunk_at, p.first AS start, p.last AS "end", md5(t.text[p.first + 1:p.last]) AS chunk_md5 FROM places p JOIN texts t ON p.doc_id = t.doc_id""",
    "file_catalog": f"""
WITH {_FILES}
SELECT path, name, CASE WHEN doc_id % 5 < 4 THEN lower(substr(['.PDF', '.md', '.txt', '.exe', ''][doc_id % 5 + 1], 2)) END AS extension, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256,
       CASE WHEN doc_id % 5 >= 3 THEN 'extension_not_supported' WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN octet_length(encode(text)) > 3000 THEN 'too_large'
            WHEN doc_id % 7 = 0 THEN 'media_type_differs' END AS rule
FROM files""",
    "outputs_of_folders": f"""
WITH {_FILES}
SELECT CAST(doc_id // 10 AS VARCHAR) AS run, ['md', 'txt'][doc_id % 5] AS extension, min(path) AS path, md5(arg_min(text, path)) AS text_md5
FROM files WHERE doc_id % 5 IN (1, 2) GROUP BY ALL""",
    "pages_of_results": """
WITH pages AS (
  SELECT o_orderkey AS n, unnest([{'at': 0, 'page': '{"a":' || o_orderkey || '}'}, {'at': 0, 'page': '{"a":2}'}, {'at': 1, 'page': '{"b":' || o_orderkey % 3 || '}'}, {'at': 2, 'page': '{"c":3}'}]) AS p, unnest([1, 2, 3, 4]) AS k
  FROM orders
)
SELECT n AS "order", row_number() OVER (PARTITION BY n ORDER BY k) AS page_number, p.page AS page FROM pages WHERE (n + p.at) % 4 <> 0""",
    "artifact_rows": """
SELECT CAST(event_id AS VARCHAR) AS run_id, 3::BIGINT AS n_artifacts, 1::BIGINT AS n_images, event_id + event_id % 10 AS result_size_bytes FROM events""",
    "merged_configurations": """
SELECT o_orderkey, config, substr(sha256(config), 1, 12) AS config_hash
FROM (SELECT o_orderkey, '{"a":"' || o_orderstatus || '","b":' || CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '{"x":1,"y":' || CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 ELSE o_orderkey % 3 END || '}' END || '}' AS config FROM orders)""",
    "percentiles_of_values": """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS p100 FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "dataset_changes": """
WITH later AS (SELECT CASE WHEN doc_id % 91 = 7 THEN -doc_id ELSE doc_id END AS doc_id, text, CASE WHEN doc_id % 50 = 3 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 77 <> 5)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents a FULL JOIN later b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang""",
    "changed_ranges": """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE doc_id % 77 <> 5) AS rows_after, true AS paths_hold FROM documents""",
    "rebuilt_turns": """
SELECT a.conv_id, a.turn, md5(coalesce(a.text, '')) AS base_md5, md5(coalesce(b.text, '')) AS target_md5, true AS counts_hold
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "span_places": """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
       'EMAIL:4:' || 12 + length(CAST(o_orderkey AS VARCHAR)) || CASE WHEN o_orderkey % 3 = 0 THEN ',PHONE:' || 16 + length(CAST(o_orderkey AS VARCHAR)) || ':' || 29 + length(CAST(o_orderkey AS VARCHAR)) ELSE '' END AS places,
       CASE WHEN o_orderkey % 3 = 0 THEN 'see [EMAIL] or [PHONE] now' ELSE 'see [EMAIL] or nothing now' END AS deidentified_text,
       CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS detected_entity_count, 26::BIGINT AS output_characters
FROM orders""",
    "masking_inputs": """
SELECT doc_id, md5(CASE WHEN trim(CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END WHEN 3 THEN text END) <> ''
                        THEN CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 3 THEN text END END) AS input_md5
FROM documents""",
    "blocks_for_research": r"""
WITH parts AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents
),
whole AS (
  SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 AND len(parts) > 0 THEN parts[k] ELSE text END AS text, doc_id % 2 = 0 AND len(parts) > 0 AS own
  FROM (SELECT *, unnest(range(1, CASE WHEN doc_id % 2 = 0 AND len(parts) > 0 THEN len(parts) ELSE 1 END + 1)) AS k FROM parts WHERE text <> '')
)
SELECT doc_id || ':r:1:' || CASE WHEN own THEN 'block-' || k ELSE 'page-text' END AS block_id, CAST(doc_id AS VARCHAR) AS document_id, 1::BIGINT AS page_number,
       CASE WHEN own THEN 'block-' || k ELSE 'page-text' END AS canonical_block_id, 'paragraph' AS block_type, k - 1 AS reading_order, md5(text) AS text_md5
FROM whole""",
    "chosen_questions": """
WITH rows AS (SELECT o_orderkey AS n, CAST(o_orderkey // 2 AS VARCHAR) AS id FROM orders)
SELECT 'chosen' AS part, count(*) AS n FROM rows WHERE n % 10 IN (1, 2, 4) AND n % 4 <> 0 AND n % 3 <> 0
UNION ALL SELECT 'excluded', count(*) FROM rows WHERE n % 10 IN (1, 2, 4) AND NOT (n % 4 <> 0 AND n % 3 <> 0)
UNION ALL SELECT 'repeated_question_id', count(*) FROM (SELECT id FROM rows GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'document_without_question', 1""",
    "grid_of_conditions": """
WITH names AS (SELECT unnest(['baseline', 'no_op', 'A', 'B', 'AB']) AS condition),
cases AS (SELECT DISTINCT coalesce(source, 'none') AS case_id FROM documents)
SELECT case_id, r AS repeat_id, row_number() OVER (PARTITION BY case_id, r ORDER BY sha256(case_id || ':' || r || ':' || condition)) - 1 AS place, condition
FROM cases, names, (SELECT unnest([1, 2])::BIGINT AS r)""",
    "runs_of_connectors": """
SELECT o_orderkey, c_name AS parser_name, c_mktsegment AS parser_version FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 AND (lower(c_mktsegment) LIKE '%building%' OR lower(c_name) LIKE '%building%')""",
    "upserted_scores": """
SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 20 FROM supplier) UNION ALL SELECT s_suppkey * 20, 1.0::DOUBLE FROM supplier""",
    "runner_gate": """
SELECT doc_id, unnest([[], ['other_fields', 'schema_or_repeat', 'no_blocks_or_questions'], ['schema_or_repeat'], ['no_blocks_or_questions'], ['block_not_object'], ['block_field_not_allowed'],
                       ['block_field_missing', 'block_text_not_string'], ['page_number_not_positive'], ['page_number_not_positive', 'run_id_not_string', 'repeated_block_id'],
                       ['question_fields', 'repeated_question_id'], ['question_not_string', 'document_without_blocks'], ['other_fields']][doc_id % 12 + 1]) AS rule
FROM documents""",
    "execution_gate": """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'not_complete' AS rule, NULL AS detail FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'case_changed', NULL FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0
UNION ALL SELECT CAST(CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS VARCHAR), 'output_changed', 'e' || o_orderkey FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT CAST(-o_orderkey AS VARCHAR), 'unknown_run', 'e' || o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey <> 0""",
    "pages_of_pipelines": r"""
WITH pages AS (
  SELECT doc_id, [coalesce(source, 's') || chr(10) || chr(10) || 'b', coalesce(lang, 'l') || chr(10) || 'line', 'only', ''] AS t, ['m' || chr(10) || chr(10) || coalesce(lang, 'l'), 'whole', 'only', ''] AS m FROM documents
)
SELECT doc_id, array_to_string(list_filter([t[doc_id % 4 + 1], t[(doc_id + 1) % 4 + 1]], lambda x: x <> ''), chr(10) || chr(10)) AS text,
       array_to_string(list_filter([m[doc_id % 4 + 1], m[(doc_id + 1) % 4 + 1]], lambda x: x <> ''), chr(10) || chr(10)) AS markdown
FROM pages""",
    "variants_with_prefix": """
WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE coalesce(lang, '') END AS text FROM documents),
clean AS (
  SELECT doc_id, CASE WHEN length(text) < 20 THEN ['Mock parser extracted a ' || octet_length(encode(text)) || '-byte document.', 'Binary formats are represented by deterministic sample text in Phase 1.'] ELSE [text] END AS lines FROM texts
),
made AS (
  SELECT doc_id, unnest([{'name': 'standard', 'lines': lines}, {'name': 'uppercase', 'lines': list_transform(lines, lambda x: upper(x))},
                         {'name': 'line_numbered', 'lines': list_transform(lines, lambda x, i: lpad(CAST(i AS VARCHAR), 3, '0') || ' | ' || x)}]) AS v FROM clean
)
SELECT doc_id, v.name AS parser_name, array_to_string(list_concat(['Draft', ''], v.lines), chr(10)) AS parsed_text, array_to_string(list_concat(['Draft'], v.lines), chr(10) || chr(10)) AS markdown FROM made""",
    "results_by_adapter": """
SELECT doc_id, ['own', 'other', 'list'][doc_id % 4 + 1] AS adapter_key, coalesce(source, 's') AS full_text, 1::BIGINT AS n_blocks FROM documents WHERE doc_id % 4 < 3""",
    "truths_of_owner": """
SELECT o_orderkey AS truth_id, CAST(o_custkey AS VARCHAR) AS document_id, c_name AS document_filename FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""",
    "preflight_of_cases": f"""
WITH RECURSIVE {_SEGMENTS.replace("length(CAST(doc_id AS VARCHAR))", "1").replace("length(CAST(s.doc_id AS VARCHAR))", "1")},
sums AS (SELECT doc_id, max(batch) + 1 AS batches FROM packed GROUP BY doc_id)
SELECT CAST(s.doc_id AS VARCHAR) AS case_id, batches, 3::BIGINT AS questions, length(t.text) AS input_characters, 10 * (batches + 3) AS calls, 10 * (batches * 12000 + 3 * 1200) AS max_output_tokens
FROM sums s JOIN texts t ON s.doc_id = t.doc_id""",
    "pairs_of_runs": """
WITH places AS (SELECT conv_id, turn, length(text) AS n, count(*) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS later FROM conversations)
SELECT conv_id AS experiment_id, CAST(sum(later) AS BIGINT) AS n, CAST(sum(n * later) AS BIGINT) AS base_chars, 'all' AS kind FROM places GROUP BY conv_id HAVING sum(later) > 0
UNION ALL SELECT conv_id, later, n * later, 'first' FROM places WHERE turn = 0 AND later > 0""",
    "questions_with_blocks": """
SELECT 'c' AS case_id, c_name AS question_id, CAST(c_custkey AS VARCHAR) AS document_id, c_mktsegment AS question FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)""",
    "matches_by_rule": r"""
WITH coded AS (SELECT o_orderkey, len(regexp_extract_all(o_orderpriority, '\d-[A-Z]+')) AS n_code, regexp_replace(o_orderpriority, '\d-[A-Z]+', '[CODE]', 'g') AS text FROM orders)
SELECT o_orderkey, n_code, len(regexp_extract_all(text, '[A-Z]{2,}')) AS n_word, regexp_replace(text, '[A-Z]{2,}', '[WORD]', 'g') AS masked FROM coded""",
    "stages_of_runs": """
SELECT event_id AS run_id, 0::BIGINT AS stage_at, 'parse' AS stage, '{"event_type":"' || event_type || '"}' AS "row" FROM events
UNION ALL SELECT event_id, 1, 'score', '{"user":' || user_id || '}' FROM events WHERE user_id % 2 = 0""",
}
