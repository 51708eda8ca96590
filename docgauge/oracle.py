"""The queries of docgauge.queries in SQL (DuckDB), for checks on the same tables."""

from __future__ import annotations

#: Lines that aren't blank, as paragraph blocks.
_BLOCKS = r"""
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
blocks AS (
  SELECT doc_id, trim(line, ' ') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS reading_order
  FROM lines WHERE trim(line, ' ') <> ''
)"""

_CLEAN = r"""
clean AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM documents
),
variants AS (
  SELECT doc_id, 'standard' AS parser_name, text FROM clean
  UNION ALL SELECT doc_id, 'uppercase', upper(replace(text, 'ß', 'SS')) FROM clean
  UNION ALL SELECT doc_id, 'line_numbered', array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: printf('%03d', i) || ' | ' || line), chr(10)) FROM clean
)"""

_RUNS = """
runs AS (
  SELECT event_id, user_id, user_id % 50 AS document, 'parser' || event_id % 4 AS parser_name, event_id % 2 AS config, ts, CAST(floor(value * 10) + 1 AS BIGINT) AS latency_ms,
         CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS parse_status
  FROM events
),
evaluated AS (
  SELECT *, (event_id * 37 % 101) / 100 AS text_accuracy, (event_id * 53 % 151) / 100 AS text_cer,
         CASE WHEN event_id % 3 = 0 THEN (event_id * 17 % 101) / 100 END AS overall_quality, event_id % 9 + 1 AS page_count
  FROM runs WHERE parse_status = 'SUCCEEDED'
)"""

_T = "[12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]"


def _intervals(values: str, keys: str) -> str:
    """Mean and clamped Student interval of values (keys, metric, value)."""
    return f"""
grouped AS (
  SELECT {keys}, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS deviation FROM ({values}) WHERE value IS NOT NULL GROUP BY ALL
),
halves AS (
  SELECT *, CASE WHEN n > 1 THEN CASE WHEN n <= 31 THEN list_extract({_T}, n - 1)::DOUBLE ELSE 1.96 END * deviation / sqrt(n) END AS half FROM grouped
)"""


_BOUNDS = "CASE WHEN half IS NOT NULL THEN round(greatest(0, mean - half), 6) END AS ci_low, CASE WHEN half IS NOT NULL THEN round(CASE WHEN metric = 'text_cer' THEN mean + half ELSE least(1, mean + half) END, 6) END AS ci_high"


def _f1(tp: str, fp: str, fn: str, names: tuple[str, str, str]) -> str:
    p, r = f"{tp} / nullif({tp} + {fp}, 0)", f"{tp} / nullif({tp} + {fn}, 0)"
    return f"""round({p}, 6) AS {names[0]}, round({r}, 6) AS {names[1]},
       CASE WHEN {p} + {r} > 0 THEN round(2 * ({p}) * ({r}) / ({p} + {r}), 6) WHEN {tp} + {fp} + {fn} > 0 THEN 0.0 END AS {names[2]}"""


_CASE = """
cases AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, coalesce(text, '') AS text FROM documents)"""

_JUDGED = """
judged AS (
  SELECT d.source AS case_id, l.doc_id, c.condition, l.quality = 1 AS base,
         CASE c.condition WHEN 'A' THEN l.quality = 1 OR l.doc_id % 2 = 0 WHEN 'B' THEN l.quality = 1 AND l.toxic = 0 WHEN 'AB' THEN l.doc_id % 3 <> 0 ELSE l.quality = 1 END AS correct
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (VALUES ('baseline'), ('no_op'), ('A'), ('B'), ('AB')) c(condition)
),
outcomes AS (
  SELECT case_id, condition, count(*) FILTER (WHERE correct) AS correct_count, count(*) AS question_count,
         count(*) FILTER (WHERE correct AND NOT base) AS n_recovered, count(*) FILTER (WHERE base AND NOT correct) AS n_regressed
  FROM judged GROUP BY ALL
)"""

_CELLS = """
cells AS (
  SELECT l_orderkey AS o, l_linenumber AS r, l_suppkey % 3 AS c, 'part ' || l_partkey AS text, l_partkey AS part, l_returnflag AS flag,
         row_number() OVER () AS n FROM lineitem
),
g AS (SELECT o, r, c, text FROM cells WHERE part % 7 <> 0),
p AS (SELECT o, r, c, text || CASE WHEN flag = 'R' THEN '!' ELSE '' END AS text FROM cells WHERE part % 5 <> 0)"""

SQL: dict[str, str] = {
    "leaderboard_of_variants": rf"""
WITH {_CLEAN},
truth AS (
  SELECT DISTINCT doc_id, text FROM (
    SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[\s\x0B\x85\x{{A0}}]+', ' ', 'g'), ' ') AS text FROM documents) WHERE text <> ''
),
found AS (
  SELECT DISTINCT doc_id, parser_name, text FROM (
    SELECT doc_id, parser_name, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s\x0B\x85\x{{A0}}]+', ' ', 'g'), ' ') AS text FROM variants) WHERE text <> ''
),
expected AS (SELECT t.doc_id, v.parser_name, t.text FROM truth t, (VALUES ('standard'), ('uppercase'), ('line_numbered')) v(parser_name)),
runs AS (
  SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, coalesce(e.parser_name, f.parser_name) AS parser_name, count(e.text) AS g, count(f.text) AS p, count(*) FILTER (WHERE e.text IS NOT NULL AND f.text IS NOT NULL) AS tp
  FROM expected e FULL JOIN found f ON e.doc_id = f.doc_id AND e.parser_name = f.parser_name AND e.text = f.text GROUP BY ALL
),
{_intervals("SELECT parser_name, 'recall' AS metric, tp / nullif(g, 0) AS value FROM runs UNION ALL SELECT parser_name, 'f1', CASE WHEN tp > 0 THEN 2 * tp / (g + p) WHEN g + p > 0 THEN 0.0 END FROM runs", "parser_name")}
SELECT parser_name, metric, n, round(mean, 6) AS mean, {_BOUNDS} FROM halves""",
    "text_blocks": f"""
WITH {_BLOCKS}
SELECT doc_id, 'block-' || (reading_order + 1) AS block_id, reading_order, length(text) AS n_chars, md5(text) AS text_md5 FROM blocks""",
    "run_summaries": f"""
WITH {_BLOCKS},
counted AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS run_id, md5(left(coalesce(text, ''), 1000)) AS preview_md5, length(coalesce(text, '')) AS text_length,
       CAST(coalesce(text, '') <> '' AS BIGINT) AS page_count, coalesce(n, 0) AS block_count, CAST(0 AS BIGINT) AS table_count, CAST(0 AS BIGINT) AS image_count
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id""",
    "parser_variants": f"WITH {_CLEAN} SELECT doc_id, parser_name, length(text) AS n_chars, md5(text) AS text_md5 FROM variants",
    "segments_and_chunks": """
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(start + 1000, length(text)) AS BIGINT) AS "end", md5(substr(text, start + 1, 1000)) AS segment_md5
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS start FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""",
    "bm25_top": r"""
WITH corpus AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+|[가-힣]+'), lambda t: lower(t)) AS tokens FROM documents
),
sizes AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_size FROM corpus),
asked AS (
  SELECT item_id AS query_id, token, count(*) AS times
  FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[0-9A-Za-z]+|[가-힣]+'), lambda t: lower(t))) AS token FROM benchmark) GROUP BY ALL
),
terms AS (
  SELECT doc_id, size, token, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS token FROM corpus) WHERE token IN (SELECT token FROM asked) GROUP BY ALL
),
frequency AS (SELECT token, count(*) AS df FROM terms GROUP BY token),
scored AS (
  SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))), 8) AS score
  FROM asked JOIN terms USING (token) JOIN frequency USING (token), sizes GROUP BY query_id, doc_id
)
SELECT query_id, rank, round(score, 4) AS score
FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored) WHERE rank <= 5""",
    "corpus_statistics": r"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df
FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+|[가-힣]+'), lambda t: lower(t))) AS token FROM documents) GROUP BY token""",
    "empty_lines": f"""
WITH {_BLOCKS}
SELECT CAST(doc_id AS VARCHAR) AS document_id, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS empty_pages FROM lines WHERE trim(line, ' ') = '' GROUP BY doc_id""",
    "text_scores": r"""
WITH turns AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20-\x7e]+', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.text AS r, b.text AS p, CAST(levenshtein(a.text, b.text) AS BIGINT) AS d FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, d AS text_edit_distance,
       round(CASE WHEN length(r) > 0 THEN d / length(r) WHEN length(p) = 0 THEN 0.0 ELSE 1.0 END, 6) AS text_cer,
       round(greatest(0.0, 1 - d / greatest(length(r), length(p), 1)), 6) AS text_accuracy, CASE WHEN r = p THEN 1.0 ELSE 0.0 END AS text_exact_match
FROM pairs""",
    "cell_scores": f"""
WITH {_CELLS},
paired AS (
  SELECT coalesce(g.o, p.o) AS o, g.text IS NOT NULL AS has_g, p.text IS NOT NULL AS has_p, coalesce(g.text, '') AS a, coalesce(p.text, '') AS b
  FROM g FULL JOIN p ON g.o = p.o AND g.r = p.r AND g.c = p.c
),
summed AS (
  SELECT o, count(*) FILTER (WHERE has_g AND has_p) AS tp, count(*) FILTER (WHERE has_g) AS n_g, count(*) FILTER (WHERE has_p) AS n_p,
         sum(levenshtein(a, b)) AS distance, sum(greatest(length(a), length(b))) AS size FROM paired GROUP BY o
)
SELECT CAST(o AS VARCHAR) AS run_id, tp AS matched_cells, n_g AS ground_truth_cells, n_p AS prediction_cells,
       {_f1("tp", "(n_p - tp)", "(n_g - tp)", ("table_structure_precision", "table_structure_recall", "table_structure_f1"))},
       round(greatest(0.0, 1 - distance / nullif(size, 0)), 6) AS table_content_accuracy
FROM summed""",
    "entity_scores": f"""
WITH found AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS type, l_linenumber AS place, l_partkey % 3 <> 0 AS g, l_suppkey % 4 <> 0 AS p FROM lineitem),
spans AS (SELECT o, type, place, bool_or(g) AS g, bool_or(p) AS p FROM found GROUP BY ALL),
summed AS (SELECT o, count(*) FILTER (WHERE g) AS n_g, count(*) FILTER (WHERE p) AS n_p, count(*) FILTER (WHERE g AND p) AS tp FROM spans WHERE g OR p GROUP BY o)
SELECT CAST(o AS VARCHAR) AS run_id, n_g AS ground_truth_pii_entities, n_p AS prediction_pii_entities, tp AS matched_pii_entities,
       {_f1("tp", "(n_p - tp)", "(n_g - tp)", ("pii_precision", "pii_recall", "pii_f1"))},
       round(1 - tp / nullif(n_g, 0), 6) AS pii_leakage_rate, round(1 - tp / nullif(n_p, 0), 6) AS pii_overmask_rate
FROM summed""",
    "layout_scores": f"""
WITH boxes AS (
  SELECT l_orderkey AS o, max(l_returnflag) AS type, l_linenumber AS i, l_linenumber * 100.0::DOUBLE AS x, max(l_quantity) AS w, round(max(l_discount) * 100) / 4 AS moved
  FROM lineitem GROUP BY l_orderkey, l_linenumber
),
shared_areas AS (
  SELECT g.o, greatest(0, least(g.x + g.w, p.x + p.moved + p.w) - greatest(g.x, p.x + p.moved)) * 10 AS shared, (g.w + p.w) * 10 AS areas
  FROM boxes g JOIN boxes p ON g.o = p.o AND g.type = p.type AND g.i = p.i
),
matched AS (SELECT o, count(*) AS tp, avg(shared / (areas - shared)) AS mean_iou FROM shared_areas WHERE areas > shared AND shared / (areas - shared) >= 0.5 GROUP BY o),
counted AS (SELECT o, count(*) AS n FROM boxes GROUP BY o),
joined AS (SELECT c.o, n, coalesce(tp, 0) AS tp, mean_iou FROM counted c LEFT JOIN matched m ON c.o = m.o)
SELECT CAST(o AS VARCHAR) AS run_id, n AS layout_ground_truth_blocks, n AS layout_prediction_blocks, tp AS layout_matches_iou50,
       {_f1("tp", "(n - tp)", "(n - tp)", ("layout_precision_iou50", "layout_recall_iou50", "layout_f1_iou50"))}, round(mean_iou, 6) AS layout_mean_iou
FROM joined""",
    "metric_summary": f"""
WITH {_RUNS},
{_intervals("SELECT parser_name, config, metric, value FROM (UNPIVOT (SELECT parser_name, config, text_accuracy, text_cer, overall_quality FROM evaluated) ON text_accuracy, text_cer, overall_quality INTO NAME metric VALUE value)", "parser_name, config")}
SELECT parser_name, '1' AS parser_version, metric, n, round(mean, 6) AS mean, {_BOUNDS}, config = 0 AS first_config FROM halves""",
    "operations_summary": f"""
WITH {_RUNS},
grouped AS (
  SELECT parser_name, config, count(*) AS n_runs, count(DISTINCT document) AS n_documents, quantile_cont(latency_ms::DOUBLE, 0.5) AS p50, quantile_cont(latency_ms::DOUBLE, 0.95) AS p95,
         sum(page_count) / (sum(latency_ms) / 60000) AS ppm, avg(overall_quality) AS quality,
         string_agg(DISTINCT 'set@' || document % 3, ',' ORDER BY 'set@' || document % 3) AS dataset_versions
  FROM evaluated GROUP BY ALL
)
SELECT parser_name, n_runs, n_documents, round(p50, 4) AS latency_p50, round(p95, 4) AS latency_p95, round(ppm, 4) AS pages_per_minute, dataset_versions,
       row_number() OVER (ORDER BY coalesce(nullif(quality, 0), -1) DESC, parser_name, config) AS rank
FROM grouped""",
    "recent_evaluations": f"WITH {_RUNS} SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(document AS VARCHAR) AS document_id, parser_name, text_accuracy FROM evaluated ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 50",
    "experiment_statuses": f"""
WITH {_RUNS},
counted AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE parse_status = 'PENDING') AS pending, count(*) FILTER (WHERE parse_status IN ('PENDING', 'RUNNING')) AS unfinished,
         count(*) FILTER (WHERE parse_status = 'SUCCEEDED') AS done FROM runs GROUP BY user_id
)
SELECT CAST(user_id AS VARCHAR) AS experiment_id, n AS n_runs, done AS n_succeeded, round(100 * (n - unfinished) / n, 6) AS progress,
       CASE WHEN pending = n THEN 'PENDING' WHEN unfinished > 0 THEN 'RUNNING' WHEN done = 0 THEN 'FAILED' WHEN done <> n THEN 'PARTIALLY_COMPLETED' ELSE 'COMPLETED' END AS status
FROM counted""",
    "operations_board": f"WITH {_RUNS} SELECT parser_name, count(*) AS n_runs, round(avg(latency_ms), 6) AS average_latency_ms FROM runs GROUP BY parser_name",
    "daily_runs": """
SELECT CAST(day AS VARCHAR) AS day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = day) AS n_runs
FROM (SELECT CAST(unnest(generate_series(last - 6, last, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT max(CAST(ts AS DATE)) AS last FROM events))""",
    "latest_runs": f"""
WITH {_RUNS}
SELECT CAST(user_id AS VARCHAR) AS experiment_id, CAST(event_id AS VARCHAR) AS run_id, parse_status FROM runs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1""",
    "repaired_texts": f"""
WITH {_CASE},
edited AS (
  SELECT case_id, condition, CASE WHEN condition IN ('A', 'AB') AND text <> '' THEN '<first>' ELSE left(text, 1) END
         || CASE WHEN condition IN ('B', 'AB') AND length(text) > 10 THEN substr(text, 2, 4) || substr(text, 11) ELSE substr(text, 2) END AS text
  FROM cases, (VALUES ('baseline'), ('no_op'), ('A'), ('B'), ('AB')) c(condition)
)
SELECT case_id, condition, length(text) AS n_chars, md5(text) AS text_md5 FROM edited""",
    "inverse_edits": f"""
WITH {_CASE}
SELECT case_id, 'A' AS candidate_id, CAST(0 AS BIGINT) AS start, CAST(7 AS BIGINT) AS "end", '<first>' AS before, left(text, 1) AS after FROM cases WHERE text <> ''
UNION ALL
SELECT case_id, 'B', CAST(11 AS BIGINT), CAST(11 AS BIGINT), '', substr(text, 6, 5) FROM cases WHERE length(text) > 10""",
    "repair_outcomes": f"WITH {_JUDGED} SELECT case_id, condition, correct_count, question_count, round(correct_count / question_count, 6) AS accuracy, n_recovered, n_regressed, n_recovered - n_regressed AS net_recovery FROM outcomes",
    "repair_interactions": f"""
WITH {_JUDGED}, gains AS (SELECT case_id, condition, n_recovered - n_regressed AS gain FROM outcomes)
SELECT case_id, CAST(sum(CASE condition WHEN 'AB' THEN gain WHEN 'A' THEN -gain WHEN 'B' THEN -gain ELSE 0 END) AS BIGINT) AS interaction_count,
       CAST(sum(CASE condition WHEN 'no_op' THEN gain ELSE 0 END) AS BIGINT) AS no_op_net_change FROM gains GROUP BY case_id""",
    "repair_gate": f"""
WITH {_CASE}
SELECT rule, n FROM (SELECT 'not_exactly_a_and_b' AS rule, count(*) AS n FROM cases WHERE length(text) BETWEEN 1 AND 10) WHERE n > 0""",
    "csv_guard": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN '''' ELSE '' END || substr('=+-@x', CAST(o_orderkey % 5 + 1 AS BIGINT), 1) || o_orderpriority AS safe FROM orders""",
}
