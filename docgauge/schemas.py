"""Schemas of the library's tables, as DDL."""

BBOX = "struct<x1: double, y1: double, x2: double, y2: double>"
CELL = "struct<row: int, column: int, row_span: int, column_span: int, text: string>"
BLOCK = f"struct<id: string, type: string, page_number: int, reading_order: int, text: string, bbox: {BBOX}, confidence: double, html: string, latex: string, cells: array<{CELL}>, attributes: string>"
PAGE = f"struct<page_number: int, width: double, height: double, text: string, blocks: array<{BLOCK}>>"
PAGES = f"array<{PAGE}>"
ENTITIES = "array<struct<type: string, start: int, end: int>>"

CANONICAL = f"document_id string, run_id string, schema_version string, parser_name string, parser_version string, parser_config string, full_text string, markdown string, pages {PAGES}, metadata string"
GROUND_TRUTH = f"document_id string, dataset_name string, dataset_version string, schema_version string, full_text string, pages {PAGES}, pii_entities {ENTITIES}"
RUNS = "run_id string, experiment_id string, document_id string, parser_name string, parser_version string, config string, parse_status string, deidentification_status string, latency_ms bigint, created_at timestamp"
ARTIFACTS = "array<struct<name: string, path: string, media_type: string, size_bytes: bigint, source: string, archive_entry: boolean>>"
RUN_RESULTS = f"run_id string, page_count int, text_length int, block_count int, table_count int, image_count int, artifact_manifest {ARTIFACTS}"
DEIDENTIFIED = f"run_id string, entities {ENTITIES}, deidentified_text string, detected_entity_count int, masked_entity_count int"
MANUAL = "run_id string, evaluator_id string, text_score int, table_score int, reading_order_score int, deidentification_score int, is_preferred boolean, notes string, updated_at timestamp"
BLOCKS = f"case_id string, block_id string, document_id string, page_number int, text string, source_kind string, run_id string, canonical_block_id string, block_type string, reading_order int, bbox {BBOX}, parser_name string, parser_version string, page_width double, page_height double"
QUESTIONS = "case_id string, question_id string, document_id string, question string"
REPAIRS = "case_id string, candidate_id string, block_id string, start int, end int, before string, after string, source_note string"
JUDGMENTS = "judgment_id string, correct boolean, judge_id string, rationale string"

#: The block types of a canonical document.
BLOCK_TYPES = ("title", "heading", "paragraph", "list", "table", "image", "caption", "formula", "header", "footer", "unknown")
EVALUATOR_VERSION = "1.0.0"
