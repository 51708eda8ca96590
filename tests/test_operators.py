"""Normalizers, gates, masking, comparison, retrieval, repair, operations, files, streaming."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from docgauge.operators import benchmark, compare, gates, masking, normalize, operations, repair, retrieval, structure
from docgauge.schemas import BLOCKS, CANONICAL, GROUND_TRUTH, MANUAL, QUESTIONS, REPAIRS, RUN_RESULTS, RUNS
from docgauge.sources import files


def one(spark, function, payload):
    (row,) = function(spark.createDataFrame([(json.dumps(payload) if not isinstance(payload, str) else payload,)], "raw string")).collect()
    return row


# -- normalizers ------------------------------------------------------------------


def test_nested_tree(spark):
    row = one(spark, normalize.nested_tree, {"result": {"pages": [{"page_number": 1, "blocks": [
        {"type": "TITLE", "text": "제목", "bbox": [1, 2, 3, 4], "confidence": 0.9},
        {"type": "table", "text": "", "cells": [{"row_index": 0, "column": "1", "text": "이름"}, {"row": "bad"}]}]},
        {"elements": [{"type": "odd", "bounding_box": {"x1": 5, "y1": 6, "x2": 7, "y2": 8}, "contents": [{"text": "첫 문장"}, {"children": ["둘째 문장"]}]}, "no object"]}]}})
    first, second = row["pages"]
    assert [b["type"] for b in first["blocks"]] == ["title", "table"] and first["blocks"][0]["bbox"]["x1"] == 1
    assert first["blocks"][1]["cells"][0]["text"] == "이름" and first["blocks"][1]["cells"][0]["column"] == 1 and len(first["blocks"][1]["cells"]) == 1
    (block,) = second["blocks"]
    assert block["type"] == "unknown" and block["id"] == "p2-b1" and block["reading_order"] == 2 and block["bbox"]["x1"] == 5
    assert block["text"] == second["text"] == "첫 문장\n둘째 문장"
    assert row["full_text"] == "제목\n\n첫 문장\n둘째 문장"


def test_nested_tree_without_pages(spark):
    row = one(spark, normalize.nested_tree, {"text": "whole", "markdown": "# m", "blocks": [{"type": "paragraph", "text": "a"}]})
    assert row["full_text"] == "whole" and row["markdown"] == "# m" and row["pages"][0]["text"] == "whole" and row["pages"][0]["blocks"][0]["text"] == "a"


def test_pipeline_result(spark):
    row = one(spark, normalize.pipeline_result, {"content": {"markdown": "md", "pages": [
        {"raw": {"res": {"page_index": 4, "width": 10, "parsing_res_list": [
            {"block_label": "doc_title", "block_content": "T", "block_bbox": [0, 0, 1, 1], "block_order": 7},
            {"block_label": "table", "block_content": "x"}, {"block_label": "chart", "block_content": ""}, {"block_label": "table", "block_content": "y"}],
            "table_res_list": [{"pred_html": "<t1>"}, {"pred_html": "<t2>"}]}}},
        {"markdown": "only markdown", "raw": {}}]}})
    first, second = row["pages"]
    assert first["page_number"] == 5 and [b["type"] for b in first["blocks"]] == ["title", "table", "unknown", "table"]
    assert [b["html"] for b in first["blocks"]] == [None, "<t1>", None, "<t2>"] and [b["reading_order"] for b in first["blocks"]] == [7, 1, 2, 3]
    assert second["text"] == "only markdown" and row["full_text"] == "T\n\nx\n\ny\n\nonly markdown" and row["markdown"] == "md"


def test_content_list(spark):
    items = [{"type": "title", "text": " T ", "bbox": [0, 0, 5, 5], "page_idx": 0}, {"type": "text", "text": "body", "page_idx": 0}, {"type": "image", "image_caption": ["a ", "b"], "page_idx": 2}]
    for payload in ({"content_list": json.dumps(items)}, {"results": {"doc": {"content_list": items}}}):
        row = one(spark, normalize.content_list, payload)
        assert [p["page_number"] for p in row["pages"]] == [1, 3] and row["pages"][0]["blocks"][0]["bbox"]["x2"] == 5
        assert [b["type"] for b in row["pages"][0]["blocks"]] == ["title", "paragraph"] and row["pages"][1]["text"] == "a\nb"
        assert row["full_text"] == "T\n\nbody\n\na\nb"


def test_plain_and_pages(spark):
    assert one(spark, normalize.plain_text, {"result": {"full_text": "x\n\ny"}})["pages"][0]["blocks"][1]["text"] == "y"
    assert one(spark, normalize.plain_text, '"bare"')["full_text"] == "bare"
    assert one(spark, normalize.plain_text, {"other": 1})["pages"] == []
    rows = spark.createDataFrame([('{"text": "a"}',), ('[{"text": "b"}]',), ("just text",), ('"{\\"text\\": \\"c\\"}"',)], "p string").select(normalize.coerced_page(F.col("p"), F.lit(3)).alias("p"))
    assert [json.loads(r["p"]) for r in rows.collect()] == [{"text": "a"}, {"page_number": 3, "blocks": [{"text": "b"}]}, {"page_number": 3, "text": "just text"}, {"text": "c"}]
    (merged,) = spark.createDataFrame([('{"a": {"x": 1, "y": 2}}', '{"a": {"y": 3}, "b": 4}', None)], "a string, b string, c string").select(normalize.merged_config(F.col("a"), F.col("b"), F.col("c"))).first()
    assert json.loads(merged) == {"a": {"x": 1, "y": 3}, "b": 4}


def test_structure(spark):
    docs = spark.createDataFrame([("d", "one\n\n \ntwo", "r"), ("e", "", "s")], "document_id string, full_text string, run_id string").withColumn("pages", structure.text_pages(F.col("full_text")))
    made = {r["document_id"]: r["pages"] for r in docs.collect()}
    assert [b["text"] for b in made["d"][0]["blocks"]] == ["one", "two"] and made["e"] == []
    flat = structure.research_blocks(docs).collect()
    assert [r["block_id"] for r in flat] == ["d:r:1:block-1", "d:r:1:block-2"]
    variants = {r["parser_name"]: r["parsed_text"] for r in normalize.variants(docs.filter("document_id = 'd'"), "full_text").collect()}
    assert variants == {"standard": "one\n\n \ntwo", "uppercase": "ONE\n\n \nTWO", "line_numbered": "001 | one\n002 | \n003 |  \n004 | two"}


# -- gates ------------------------------------------------------------------------


def test_ground_truth_gate(spark):
    good = {"full_text": "x", "pages": [{"page_number": 1, "blocks": [{"type": "table", "text": "", "cells": [{"row": "0"}], "reading_order": 1}]}], "pii_entities": [{"type": "A", "start": 0, "end": 1}]}
    page = lambda b: {"full_text": "x", "pages": [{"blocks": [b]}]}
    cases = {
        "payload_not_object": [1], "full_text_not_string": {"pages": []}, "pages_not_array": {"full_text": ""}, "page_without_blocks_array": {"full_text": "", "pages": [{"blocks": 3}]},
        "page_number_not_integer": {"full_text": "", "pages": [{"page_number": "first"}]}, "page_number_not_positive": {"full_text": "", "pages": [{"page_number": 0}]},
        "block_not_object": page(5), "block_type_or_text_not_string": page({"text": 5}), "reading_order_not_integer": page({"reading_order": 1.5}), "cells_not_array": page({"cells": "bad"}),
        "cell_not_object": page({"cells": [1]}), "cell_coordinates_not_integer": page({"cells": [{"row": "x"}]}), "entities_not_array": {**good, "pii_entities": 3},
        "entity_without_type_or_offsets": {**good, "pii_entities": [{"start": 0, "end": 1}]}, "entity_offsets_out_of_order": {**good, "pii_entities": [{"type": "A", "start": 10, "end": 5}]},
    }
    rows = [(name, json.dumps(p)) for name, p in cases.items()] + [("good", json.dumps(good)), ("broken", "{")]
    found = {}
    for r in gates.ground_truth_violations(spark.createDataFrame(rows, "key string, payload string"), ["key"]).collect():
        found.setdefault(r["key"], set()).add(r["rule"])
    assert "good" not in found and "payload_not_object" in found["broken"]
    assert all(name in found.get(name, ()) for name in cases), {n: found.get(n) for n in cases if n not in found.get(n, ())}


CASE_BLOCKS = [("c", "b", "d", 1, "a=1 b=2")]
CASE_REPAIRS = [("c", "A", "b", 2, 3, "1", "100", "checked"), ("c", "B", "b", 6, 7, "2", "200", "checked")]


def case(spark, blocks=CASE_BLOCKS, repairs=CASE_REPAIRS, questions=(("c", "q", "d", "?"),)):
    made = [(*b, "pypdf_page_text", *[None] * 9) for b in blocks]
    return spark.createDataFrame(made, BLOCKS), spark.createDataFrame(list(questions), QUESTIONS), spark.createDataFrame(list(repairs), REPAIRS)


def test_case_gate(spark):
    assert gates.case_violations(*case(spark)).collect() == []
    broken = {
        "overlapping_repairs": {"repairs": [CASE_REPAIRS[0], ("c", "B", "b", 2, 5, "1 b", "x", "n")]},
        "before_text_differs": {"repairs": [CASE_REPAIRS[0], ("c", "B", "b", 6, 7, "3", "x", "n")]},
        "repeated_question_id": {"questions": [("c", "q", "d", "?"), ("c", "q", "d", "!")]},
        "question_of_other_document": {"questions": [("c", "q", "other", "?")]},
        "not_exactly_a_and_b": {"repairs": [CASE_REPAIRS[0]]},
        "nothing_changes": {"repairs": [CASE_REPAIRS[0], ("c", "B", "b", 6, 7, "2", "2", "n")]},
        "offsets_outside_block": {"repairs": [CASE_REPAIRS[0], ("c", "B", "b", 6, 70, "2", "x", "n")]},
        "source_note_missing": {"repairs": [CASE_REPAIRS[0], ("c", "B", "b", 6, 7, "2", "x", " ")]},
        "unknown_block": {"repairs": [CASE_REPAIRS[0], ("c", "B", "z", 6, 7, "2", "x", "n")]},
    }
    for rule, change in broken.items():
        assert rule in {r["rule"] for r in gates.case_violations(*case(spark, **change)).collect()}, rule


def test_other_gates(spark):
    questions = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    blocks = spark.createDataFrame([("b1", "d")], "block_id string, document_id string")
    answers = spark.createDataFrame([("q1", " ", ["b1", "zz"]), ("q9", "x", [])], "question_id string, answer string, evidence_block_ids array<string>")
    assert {(r["question_id"], r["rule"]) for r in gates.answer_violations(answers, questions, blocks).collect()} == {("q2", "missing"), ("q9", "unexpected"), ("q1", "blank_answer"), ("q1", "unknown_evidence")}
    raw = [("q1", "d", [("d", None)]), ("q2", "d", [(None, "e")]), ("q1", "d", [("d", None)])]
    rows = spark.createDataFrame(raw, "question_id string, doc_name string, evidence array<struct<doc_name: string, evidence_doc_name: string>>")
    chosen, excluded, broken = gates.select_questions(rows, ["d", "x"])
    assert chosen.count() == 2 and [tuple(r) for r in excluded.collect()] == [("q2", "not_single_document")]
    assert {(r[0], r[1]) for r in broken.collect()} == {("q1", "repeated_question_id"), ("x", "document_without_question")}
    manual = spark.createDataFrame([("r", "e", 9, 3, None, 1, True, "n" * 4001, None)], MANUAL)
    assert {r["rule"] for r in gates.manual_violations(manual).collect()} == {"text_score_out_of_range", "notes_too_long"}
    a, b = (gates.dataset_digest(spark.createDataFrame(x, "a int, b string")).first()[0] for x in ([(1, "x"), (2, None)], [(2, None), (1, "x")]))
    assert a == b != gates.dataset_digest(spark.createDataFrame([(1, "x"), (2, "")], "a int, b string")).first()[0]
    judged = spark.createDataFrame([("j1", None, "me"), ("j3", True, " ")], "judgment_id string, correct boolean, judge_id string")
    expected = spark.createDataFrame([("j1",), ("j2",)], "judgment_id string")
    assert {(r[0], r[1]) for r in gates.judgment_violations(expected, judged).collect()} == {("j2", "missing"), ("j3", "unexpected"), ("j1", "label_missing"), ("j3", "judge_missing")}
    runs = spark.createDataFrame([("e", "p", "pdf", ["pdf"]), ("e", "p", "exe", ["pdf"])], "experiment_id string, parser_name string, extension string, supported_formats array<string>")
    assert {r["rule"] for r in gates.experiment_violations(runs).collect()} == {"parser_repeated", "format_not_supported"}


# -- masking ----------------------------------------------------------------------


def test_masking(spark):
    text = "메일 test@example.com 전화 010-1234-5678 주민번호 900101-1234567"
    (row,) = masking.deidentify(spark.createDataFrame([("r", text)], "run_id string, text string")).collect()
    assert row["deidentified_text"] == "메일 [EMAIL] 전화 [PHONE] 주민번호 [RRN]" and row["detected_entity_count"] == 3
    places = {e["type"]: text[e["start"] : e["end"]] for e in row["entities"]}
    assert places == {"EMAIL": "test@example.com", "PHONE": "010-1234-5678", "RRN": "900101-1234567"}
    one_ = spark.createDataFrame([("900101-1234567 a@b.co 900101-1234567 c@d.co",)], "t string")
    (row,) = one_.select(masking.entity_spans(F.col("t")).alias("o"), masking.entity_spans(F.col("t"), offsets="progressive").alias("p"), masking.match_counts(F.col("t")).alias("n")).collect()
    assert [(e["start"], e["end"]) for e in row["o"] if e["type"] == "EMAIL"] == [(15, 21), (37, 43)]
    assert [e["start"] for e in row["p"] if e["type"] == "EMAIL"] == [6, 19] and row["n"] == {"RRN": 2, "EMAIL": 2, "PHONE": 0}
    masking.register_masker("digits", (("N", r"\d+"),))
    assert one_.select(masking.masked(F.lit("a1b22"), "digits")).first()[0] == "a[N]b[N]"
    vendor = spark.createDataFrame([('{"result": {"entities": [1, 2], "text": "x"}}',)], "raw string").select(masking.vendor_summary(F.col("raw")).alias("v")).first()["v"]
    assert tuple(vendor) == (2, 2, "x")


# -- comparison -------------------------------------------------------------------


def test_diffs(spark):
    repeated = "same words again " * 3000
    lines = "\n".join(["the same line of text"] * 5000)
    numbered = "\n".join(f"{i:03d} | the same line of text" for i in range(5000))
    pairs = [("계약 당사자는 A", "계약 당사자는 에이"), ("hello\n\nworld", "hello world"), ("", ""), ("", "x"), (None, "x"), (repeated, repeated), (lines, numbered), ("abc def", "abc xyz def")]
    rows = compare.text_diffs(spark.createDataFrame(pairs, "base string, target string")).collect()
    for r in rows:
        assert "".join(p["text"] for p in r["diff"] if p["type"] != "added") == r["base"]
        assert "".join(p["text"] for p in r["diff"] if p["type"] != "removed") == r["target"]
    assert (rows[0]["added_count"], rows[0]["removed_count"]) == (2, 1) and 0 < rows[0]["similarity_ratio"] < 1
    assert [rows[i]["similarity_ratio"] for i in (1, 2, 3, 5)] == [1, 1, 0, 1]


def test_comparison_and_csv(spark):
    manifest = [("a", "p1", "t", 5, "s", False), ("b", "p1", "t", 5, "s", False), ("c", "p2", "t", 7, "s", False)]
    runs = spark.createDataFrame([("r1", "e", "d", "=p", "1", "{}", "SUCCEEDED", "NONE", 5, None), ("r2", "e", "d", "q", "1", "{}", "FAILED", "NONE", None, None)], RUNS)
    results = spark.createDataFrame([("r1", 1, 2, 3, 4, 5, manifest)], RUN_RESULTS)
    deid = spark.createDataFrame([("r1", 2, 1)], "run_id string, detected_entity_count int, masked_entity_count int")
    manual = spark.createDataFrame([("r1", "me", 5, None, None, None, True, "+n", None), ("r1", "you", 1, 1, 1, 1, False, "x", None)], MANUAL)
    compared = compare.comparison(runs, results, deid, manual, "me")
    rows = {r["run_id"]: r for r in compared.collect()}
    assert rows["r1"]["result_size_bytes"] == 12 and rows["r1"]["text_score"] == 5 and rows["r2"]["is_preferred"] is False and rows["r2"]["page_count"] is None
    out = compare.csv_rows(compared).filter("notes is not null").first()
    assert out["parser_name"] == "'=p" and out["notes"] == "'+n" and len(out) == 20


# -- retrieval --------------------------------------------------------------------


def test_segments_and_batches(spark):
    blocks = spark.createDataFrame([("c", "b1", 0, "x" * 25), ("c", "b2", 1, ""), ("c", "b3", 2, "y" * 10)], "case_id string, block_id string, at int, text string")
    cut = retrieval.segments(blocks, 10)
    assert [(r["block_id"], r["start"], r["end"], len(r["segment"])) for r in cut.orderBy("at", "start").collect()] == [("b1", 0, 10, 10), ("b1", 10, 20, 10), ("b1", 20, 25, 5), ("b2", 0, 0, 0), ("b3", 0, 10, 10)]
    packed = retrieval.batches(cut, ["case_id"], ["at", "segment_at"], 400)
    assert [r["batch"] for r in packed.orderBy("at", "segment_at").collect()] == [0, 0, 1, 1, 2]
    texts = retrieval.batch_texts(packed, ["case_id"], ["at", "segment_at"], ["block_id"]).orderBy("batch").collect()
    assert texts[0]["input"].startswith('SOURCE {"block_id":"b1","text_start":0,"text_end":10}\nxxxxxxxxxx\n\nSOURCE')
    questions = spark.createDataFrame([("c", "q1"), ("c", "q2")], "case_id string, question_id string")
    (row,) = retrieval.preflight(blocks.select("case_id").distinct(), packed, questions, 2, ["x", "y", "z"], (12000, 1200)).collect()
    assert (row["batches"], row["calls"], row["max_output_tokens"], row["input_characters"]) == (3, 30, 6 * (3 * 12000 + 2 * 1200), 35)


def test_chunks(spark):
    assert retrieval.chunk_bounds("abcdefgh\nij", 10, 2) == [(0, 8), (6, 11)]
    assert retrieval.chunk_bounds("", 10, 2) == [] and retrieval.chunk_bounds("a" * 25, 10, 4) == [(0, 10), (6, 16), (12, 22), (18, 25)]
    rows = retrieval.passthrough(spark.createDataFrame([("d", "b", "abcdefgh\nij")], "document_id string, block_id string, text string"), 10, 2).orderBy("chunk_at").collect()
    assert [(r["chunk_id"], r["chunk"], r["source_block_ids"]) for r in rows] == [("d:b:0", "abcdefgh", ["b"]), ("d:b:1", "gh\nij", ["b"])]


def test_bm25(spark):
    import math

    corpus = {"c:10": "apple banana apple", "c:2": "banana cherry", "c:3": "durian"}
    chunked = spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "Apple banana banana"), ("q2", "nothing")], "query_id string, query string")
    found = {}
    for r in retrieval.bm25(queries, chunked, 3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    split = {k: v.split() for k, v in corpus.items()}
    mean = sum(map(len, split.values())) / 3

    def score(words):
        total = 0.0
        for t in ("apple", "banana", "banana"):
            df, tf = sum(t in w for w in split.values()), words.count(t)
            total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        return round(total, 8)

    assert sorted(found["q1"]) == [(1, "c:10", score(split["c:10"])), (2, "c:2", score(split["c:2"])), (3, "c:3", 0.0)]
    assert [c for _, c, _ in sorted(found["q2"])] == ["c:10", "c:2", "c:3"]


def test_answers_and_lineage(spark):
    texts = ['```json\n{"answer": "x", "evidence_chunk_ids": ["a", "b", "a"]}\n```', '{"answer": "x"}', "no", '{"answer": " ", "evidence_chunk_ids": []}', '{"answer": "x", "evidence_chunk_ids": ["z"]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(retrieval.parsed_answer(F.col("t"), F.array(F.lit("a"), F.lit("b"))).alias("p")).collect()
    assert [r["p"]["rule"] for r in rows] == [None, "other_keys", "not_json", "answer_missing", "evidence_not_retrieved"] and rows[0]["p"]["evidence_chunk_ids"] == ["a", "b"]
    known = F.array(F.lit("b1"), F.lit("b2"))
    rows = spark.createDataFrame([("x [source:b2] [source:zz]",), ("none",)], "t string").select(retrieval.cited_sources(F.col("t"), known).alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [(["b2"], "explicit_markers"), (["b1", "b2"], "batch_fallback")]
    answers = spark.createDataFrame([("q", ["k2", "k1"])], "question_id string, evidence_chunk_ids array<string>")
    chunked = spark.createDataFrame([("k1", ["b1", "b3"]), ("k2", ["b2", "b1"])], "chunk_id string, source_block_ids array<string>")
    assert retrieval.evidence_blocks(answers, chunked).first()["evidence_block_ids"] == ["b2", "b1", "b3"]


# -- paired repair ----------------------------------------------------------------


def test_repairs_and_inverse(spark):
    blocks, questions, repairs = case(spark)
    texts = {r["condition"]: r["text"] for r in repair.repaired_blocks(blocks, repairs).collect()}
    assert texts == {"baseline": "a=1 b=2", "no_op": "a=1 b=2", "A": "a=100 b=2", "B": "a=1 b=200", "AB": "a=100 b=200"}
    assert repair.repaired_blocks(blocks, repairs).columns == ["condition", *repair.SAFE_BLOCK_FIELDS] and repair.safe_questions(questions).columns == list(repair.SAFE_QUESTION_FIELDS)
    worse, inverse = repair.injected(blocks, repairs)
    assert worse.first()["text"] == "a=100 b=200" and gates.case_violations(worse, questions, inverse).collect() == []
    texts = {r["condition"]: r["text"] for r in repair.repaired_blocks(worse, inverse).collect()}
    assert texts["AB"] == "a=1 b=2" and texts["B"] == "a=100 b=2"
    grid = repair.conditions_grid(blocks, 2).collect()
    assert len(grid) == 10 and [tuple(r) for r in repair.conditions_grid(blocks, 2).collect()] == [tuple(r) for r in grid]
    spans = spark.createDataFrame([("abcab", "c"), ("abcab", "ab"), ("abc", "")], "t string, n string").select(repair.unique_span(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in spans] == [2, None, None]


def test_outcomes(spark):
    values = {"baseline": (True, False), "no_op": (False, False), "A": (True, True), "B": (True, True), "AB": (False, True)}
    rows = [("c", 1, cond, f"q{i + 1}", v) for cond, pair in values.items() for i, v in enumerate(pair)]
    scored = repair.outcomes(spark.createDataFrame(rows, "case_id string, repeat_id int, condition string, question_id string, correct boolean"))
    ab = scored.filter("condition = 'AB'").first()
    assert ab["net_recovery"] == 0 and ab["regressed_question_ids"] == ["q1"] and ab["recovered_question_ids"] == ["q2"]
    (row,) = repair.interactions(scored).collect()
    assert (row["interaction_count"], row["no_op_net_change"]) == (-2, -1)


# -- operations and summary ---------------------------------------------------------


def test_experiment_status(spark):
    cases = {
        "none": ([], "PENDING"), "pending": ([("PENDING", "N")] * 2, "PENDING"), "running": ([("RUNNING", "N"), ("PENDING", "N")], "RUNNING"), "done": ([("SUCCEEDED", "N")] * 2, "COMPLETED"),
        "partly": ([("SUCCEEDED", "N"), ("FAILED", "N")], "PARTIALLY_COMPLETED"), "failed": ([("FAILED", "N")], "FAILED"), "deid": ([("SUCCEEDED", "RUNNING")], "RUNNING"),
        "deid_failed": ([("SUCCEEDED", "FAILED")], "PARTIALLY_COMPLETED"), "deid_done": ([("SUCCEEDED", "SUCCEEDED")], "COMPLETED"),
    }
    runs = spark.createDataFrame([(e, *s) for e, (states, _) in cases.items() for s in states], "experiment_id string, parse_status string, deidentification_status string")
    experiments = spark.createDataFrame([(e,) for e in cases], "experiment_id string")
    assert {r["experiment_id"]: r["status"] for r in operations.experiment_status(experiments, runs).collect()} == {e: s for e, (_, s) in cases.items()}


def test_intervals(spark):
    rows = [("p", "1", "h", 0.8, 1.0, 1), ("p", "1", "h", 1.0, 2.0, 2), ("q", None, "h", 0.5, None, 3)]
    evaluated = spark.createDataFrame(rows, "parser_name string, parser_version string, config_hash string, text_accuracy double, text_cer double, n int")
    found = {(r["parser_name"], r["metric"]): r for r in benchmark.metric_intervals(evaluated, ["text_accuracy", "text_cer"]).collect()}
    one_ = found[("p", "text_accuracy")]
    assert abs(one_["mean"] - 0.9) < 1e-12 and (one_["ci_low"], one_["ci_high"], one_["n"]) == (0.0, 1.0, 2)
    assert found[("p", "text_cer")]["ci_high"] > 1 and found[("q", "text_accuracy")]["ci_low"] is None and ("q", "text_cer") not in found


def test_last_writes_and_preference(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in operations.latest(old, ["k"], "t").collect()) == [(1, "b"), (2, "c")]
    assert sorted(r["v"] for r in operations.upsert(old, spark.createDataFrame([(2, "z", 9)], old.schema), ["k"]).collect()) == ["a", "b", "z"]
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    manual = spark.createDataFrame([("r1", "me", True, at[0], "e"), ("r2", "me", True, at[1], "e"), ("r3", "me", False, at[2], "e")], "run_id string, evaluator_id string, is_preferred boolean, updated_at timestamp, experiment_id string")
    assert {r["run_id"]: r["is_preferred"] for r in operations.exclusive_preference(manual).collect()} == {"r1": False, "r2": True, "r3": False}


# -- files and streaming ------------------------------------------------------------


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"full_text": "x", "pages": []}).encode())
    (folder / "bad.json").write_text("{")
    (folder / "big.json").write_text(json.dumps({"full_text": "x" * 500, "pages": []}))
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.read_ground_truth(spark, str(folder), max_bytes=400).collect()}
    assert found["good.json"]["rule"] is None and json.loads(found["good.json"]["payload"])["full_text"] == "x"
    assert found["bad.json"]["rule"] == "not_json" and found["big.json"]["rule"] == "too_large"
    (folder / "empty.txt").write_text("")
    (folder / "run.exe").write_text("x")
    listed = {r["name"]: r["rule"] for r in files.catalog(spark.read.format("binaryFile").load(str(folder)).filter("path not like '%json'"), 10**6).collect()}
    assert listed == {"run.exe": "extension_not_supported"}  # Spark's file sources pass over files without bytes
    given = spark.createDataFrame([("/x/empty.txt", 0, b""), ("/x/a.pdf", 3, b"abc"), ("/x/a.png", 3, b"abc")], "path string, length long, content binary")
    assert {r["name"]: r["rule"] for r in files.catalog(given, 10**6, F.lit("application/pdf")).collect()} == {"empty.txt": "empty", "a.pdf": None, "a.png": "media_type_differs"}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps({"document_id": "d", "full_text": "t", "pages": [{"page_number": 1, "text": "t", "blocks": []}]}))
    assert files.read_canonical(spark, str(docs)).first()["pages"][0]["text"] == "t"
    files.write_json_lines(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "lines"))
    assert files.read_json_lines(spark, str(tmp_path / "lines"), "a int").first()["a"] == 1
    texts = spark.createDataFrame([("r", "a.json", '{"pages": [{"n": 1}, {"n": 2}]}'), ("r", "b.json", '[{"n": 3}]'), ("r", "c.json", "{")], "run_id string, name string, text string")
    assert [(r["page_number"], json.loads(r["page"])["n"]) for r in files.result_pages(texts, ["run_id"]).orderBy("page_number").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_scores_on_arrival(spark, tmp_path):
    from docgauge.streaming.scoring import current_scores, rescored, score_stream

    page = [{"page_number": 1, "text": "t", "blocks": []}]
    truth = spark.createDataFrame([{"document_id": "d", "full_text": "abc", "pages": page, "pii_entities": []}], GROUND_TRUTH)
    made = lambda *runs: spark.createDataFrame([{"document_id": "d", "run_id": r, "full_text": t, "pages": page} for r, t in runs], CANONICAL)
    inbox, out, marks = (str(tmp_path / x) for x in ("inbox", "out", "marks"))
    made(("r1", "abc")).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(made(("r", "")).schema).parquet(inbox)
    score_stream(stream, lambda: truth, out, marks).awaitTermination()
    made(("r1", "abd"), ("r2", "abc")).coalesce(1).write.mode("append").parquet(inbox)
    score_stream(stream, lambda: truth, out, marks).awaitTermination()
    scores = {r["run_id"]: r["text_edit_distance"] for r in current_scores(spark.read.parquet(f"{out}/batch=*")).collect()}
    assert scores == {"r1": 1, "r2": 0}
    assert rescored(made(("r1", "abd")), truth, truth.filter("document_id = 'x'")).count() == 0


def test_snapshots_trace_and_search(spark):
    connectors = spark.createDataFrame([(1, "p", "v2", "http")], "parser_id int, name string, model_version string, adapter string")
    runs = operations.with_snapshots(spark.createDataFrame([("r", 1), ("s", 9)], "run_id string, parser_id int"), connectors)
    assert {r["run_id"]: (r["parser_name"], r["parser_version"]) for r in runs.collect()} == {"r": ("p", "v2"), "s": (None, None)}
    stages = {"a": spark.createDataFrame([("r", 1)], "run_id string, x int"), "b": spark.createDataFrame([("r", "z")], "run_id string, y string")}
    assert [(r["stage_at"], r["stage"], r["row"]) for r in operations.trace(stages, ["run_id"]).orderBy("stage_at").collect()] == [(0, "a", '{"x":1}'), (1, "b", '{"y":"z"}')]
    rows = spark.createDataFrame([("Alpha", None), ("beta", "ALPHABET"), (None, None)], "a string, b string")
    assert operations.search(rows, "alpha", "a", "b").count() == 2 and operations.search(rows, "", "a").count() == 3
    blocks, questions, _ = case(spark, questions=[("c", "q", "d", "?"), ("c", "w", "other", "?")])
    assert [r["question_id"] for r in repair.matching_questions(questions, blocks).collect()] == ["q"]


def test_boards(spark):
    rows = [("r1", "e", "p", "SUCCEEDED", "NONE", 10, datetime(2024, 1, 7)), ("r2", "e", "p", "FAILED", "NONE", None, datetime(2024, 1, 5)), ("r3", "e", "q", "RUNNING", "NONE", None, datetime(2023, 1, 1))]
    runs = spark.createDataFrame(rows, "run_id string, experiment_id string, parser_name string, parse_status string, deidentification_status string, latency_ms long, created_at timestamp")
    assert tuple(operations.board(runs).first()) == (50.0, 10.0, 1, 1)
    days = operations.daily_histogram(runs, F.lit("2024-01-07").cast("date")).orderBy("day").collect()
    assert len(days) == 7 and [r["n_runs"] for r in days] == [0, 0, 0, 0, 1, 0, 1]
    assert [r["parser_name"] for r in operations.by_parser(runs, 1).collect()] == ["p"]
    stage = runs.select("run_id", operations.retry_stage(F.col("parse_status"), F.lit("FAILED"), F.col("latency_ms").isNotNull()).alias("s"))
    assert {r["run_id"]: r["s"] for r in stage.collect()} == {"r1": "deidentification", "r2": "parse", "r3": None}
    scores = spark.createDataFrame([("r1",)], "run_id string")
    assert tuple(benchmark.recompute_report(runs, scores, ["experiment_id"]).first()) == ("e", 1, 0)
    assert tuple(benchmark.totals(runs, scores).first()) == (3, 1)


def test_entry_without_training_data(tmp_path):
    """The library works with the training-data folders gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "docgauge", tmp_path / "docgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    for leftover in (False, True):
        if leftover:
            (tmp_path / "docgauge" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
