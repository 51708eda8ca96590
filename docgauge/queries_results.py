"""Vendor results, evaluations, gates, answers and comparisons as queries over the shared tables.

Results, ground truth and records are derived from whole tables; some rows are broken on
purpose, by number, so that gates have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.columns import stable_id
from docgauge.functions.frames import tasks_for
from docgauge.operators import benchmark, compare, gates, masking, normalize, operations, repair, retrieval, structure
from docgauge.plans.evaluate import METRICS, evaluate
from docgauge.schemas import ENTITIES, PAGES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (without white space at its ends), head (its first line), rest."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("text"))
    lines = F.split("text", "\n", -1)
    return rows.withColumns({"head": F.get(lines, F.lit(0)), "rest": F.array_join(F.slice(lines, 2, F.size(lines)), "\n")})


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of normalized results."""
    blocks = structure.blocks_of(rows, ["doc_id"])
    return blocks.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.col("id").alias("block_id"), "type", F.col("reading_order").cast("long").alias("reading_order"), F.md5("text").alias("text_md5"))


# -- normalizers ------------------------------------------------------------------------


def tree_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of nested content trees: a title with its text two levels down, and a paragraph of parts on a second page."""
    title = F.struct(F.lit("title").alias("type"), F.struct(F.array(F.struct(F.col("head").alias("text"))).alias("children")).alias("content"))
    part = F.struct(F.lit("whatever").alias("type"), F.lit("own").alias("id"), F.array(F.col("lang"), F.col("rest")).alias("contents"))
    page = lambda n, block: F.struct(F.lit(n).alias("page_number"), F.array(block).alias("blocks"))
    # Pages differ in shape, so they are put together as texts.
    raw = F.concat(F.lit('{"result": {"pages": ['), F.to_json(page(1, title)), F.lit(", "), F.to_json(page(3, part)), F.lit("]}}"))
    return _blocks(normalize.nested_tree(_docs(spark, sf_dir).withColumn("raw", raw)))


def pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an OCR pipeline with labels of its own; a table takes its HTML from the list of tables."""
    block = lambda label, text, order: F.struct(F.lit(label).alias("block_label"), text.alias("block_content"), F.lit(order).alias("block_order"), F.array(*map(F.lit, (0, 0, 10, 20))).alias("block_bbox"))
    result = F.struct(F.lit(4).alias("page_index"), F.array(block("doc_title", F.col("head"), 7), block("table", F.col("rest"), 3), block("seal", F.col("source"), 9)).alias("parsing_res_list"), F.array(F.struct(F.concat(F.lit("<t>"), F.col("lang"), F.lit("</t>")).alias("pred_html"))).alias("table_res_list"))
    raw = _json(content=F.struct(F.array(F.struct(F.struct(result.alias("res")).alias("raw"))).alias("pages")))
    rows = normalize.pipeline_result(_docs(spark, sf_dir).withColumn("raw", raw))
    blocks = structure.blocks_of(rows, ["doc_id"])
    return blocks.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.col("id").alias("block_id"), "type", F.col("reading_order").cast("long").alias("reading_order"), F.md5("text").alias("text_md5"), "html", F.col("bbox.y2").alias("bottom"))


def content_list_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as content lists inside several results, of which the first object counts (not the first name)."""
    item = lambda kind, page, field, text: F.concat(F.lit(f'{{"type": "{kind}", "page_idx": {page}, "{field}": '), F.to_json(F.struct(text.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("t")))) - 6), F.lit("}"))
    items = F.concat(F.lit("["), F.concat_ws(", ", item("text", 1, "text", F.col("head")), item("table", 0, "table_body", F.col("rest")), item("equation", 1, "text", F.col("source"))), F.lit("]"))
    raw = F.concat(F.lit('{"results": {"z": "no object", "y.pdf": {"content_list": '), items, F.lit('}, "a.pdf": {"content_list": []}}}'))
    return _blocks(normalize.content_list(_docs(spark, sf_dir).withColumn("raw", raw)))


def plain_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain results of four shapes: full_text in a result, text, content, and a bare string."""
    shapes = [F.concat(F.lit('{"result": '), _json(full_text=F.col("text")), F.lit("}")), _json(text=F.col("text")), _json(content=F.col("text"), markdown=F.col("head")), F.to_json(F.try_variant_get(F.parse_json(_json(t=F.col("text"))), "$.t", "variant"))]
    raw = F.element_at(F.array(*shapes), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = normalize.plain_text(_docs(spark, sf_dir).withColumn("raw", raw))
    return rows.select("doc_id", F.md5("full_text").alias("text_md5"), F.md5("markdown").alias("markdown_md5"), F.coalesce(F.size(F.flatten(F.transform("pages", lambda p: p["blocks"]))), F.lit(0)).cast("long").alias("n_blocks"))


def vendor_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and texts of vendors' de-identification results at several depths and under several names."""
    count = (F.col("doc_id") % 7).cast("int")
    shapes = [
        F.concat(F.lit('{"status": {"code": 0}, "result": [{"detectedEntityCount": '), count.cast("string"), F.lit(', "maskedEntityCount": 1, "maskedText": "m"}]}')),
        F.concat(F.lit('{"data": {"items": ['), F.array_join(F.array_repeat(F.lit("{}"), count), ", "), F.lit('], "output": "o", "deidentified_text": "d"}}')),
        F.concat(F.lit('{"totalCount": true, "inner": {"totalCount": '), count.cast("string"), F.lit('.9, "maskingCount": 2}}')),
        F.lit("no json"),
    ]
    rows = _table(spark, sf_dir, "documents").select("doc_id", masking.vendor_summary(F.element_at(F.array(*shapes), (F.col("doc_id") % 4 + 1).cast("int"))).alias("v"))
    return rows.select("doc_id", F.col("v.detected").cast("long").alias("detected"), F.col("v.masked").cast("long").alias("masked"), F.col("v.text").alias("text"))


# -- the whole evaluation ---------------------------------------------------------------


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as ground truth of two pages, the next turn as what a parser read."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")).hint("shuffle_hash"), ["conv_id", "turn"])
    pairs = pairs.withColumns({"c": F.col("conv_id").cast("long"), "t": F.col("turn").cast("long"), "run_id": F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))})
    box = lambda x, w: F.struct(x.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (x + w).cast("double").alias("x2"), F.lit(10.0).alias("y2"))
    none = F.lit(None)
    cell = lambda text: F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"), text.alias("text"))

    def block(name, kind, page, order, text, place=none, latex=none, cells=none):
        return F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(page).alias("page_number"), order.alias("reading_order"), text.alias("text"), place.alias("bbox"), none.alias("confidence"), none.alias("html"), latex.alias("latex"), cells.alias("cells"), none.alias("attributes"))

    def page(n, *blocks):
        return F.struct(F.lit(n).alias("page_number"), none.alias("width"), none.alias("height"), F.lit("").alias("text"), F.array(*[b.cast(PAGES[len("array<struct<page_number: int, width: double, height: double, text: string, blocks: array<") : -3]) for b in blocks]).alias("blocks"))

    c, t = F.col("c"), F.col("t")
    name, sentence = F.concat(F.lit("Ｃonv  "), c.cast("string")), F.concat(F.lit("turn "), t.cast("string"), F.lit(" of conversation "), c.cast("string"))
    cells = lambda k: F.array(cell(F.concat(F.lit("cell "), (c * k).cast("string"))))
    gold = F.array(
        page(1, block("a", "title", 1, F.lit(0), name, box(F.lit(0), F.lit(100))), block("b", "paragraph", 1, F.lit(1), sentence, box(F.lit(0), c % 40 + 10))),
        page(2, block("c", "table", 2, F.lit(0), F.lit(""), cells=cells(7)), block("d", "formula", 2, F.lit(1), F.lit("f"), latex=F.concat(F.lit("x_"), t.cast("string")))),
    ).cast(PAGES)
    swapped = t % 2
    read_first = page(1, block("a", "title", 1, swapped.cast("int"), F.concat(F.lit("Conv "), c.cast("string")), box(c % 120, F.lit(100))), block("b", "paragraph", 1, (1 - swapped).cast("int"), sentence, box(F.lit(0), F.lit(20))))
    read_second = page(2, block("c", "table", 2, F.lit(0), F.lit(""), cells=cells(9)), block("d", "formula", 2, F.lit(1), F.lit("f"), latex=F.concat(F.lit("x_"), (t + 9).cast("string"))))
    read = F.when(c % 5 == 0, F.array(read_first)).otherwise(F.array(read_first, read_second)).cast(PAGES)
    entity = lambda kind, start: F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), (start + 3).cast("int").alias("end"))
    truth = pairs.select(F.col("run_id").alias("document_id"), F.col("text").alias("full_text"), gold.alias("pages"), F.when(t % 2 == 0, F.array(entity("EMAIL", F.lit(0)), entity("PHONE", F.lit(9)))).otherwise(F.array()).cast(ENTITIES).alias("pii_entities"))
    found = pairs.select("run_id", F.array(entity("EMAIL", F.lit(0)), entity("PHONE", F.when(c % 3 == 0, 10).otherwise(9))).cast(ENTITIES).alias("entities"))
    predictions = pairs.select("run_id", F.col("run_id").alias("document_id"), F.col("next").alias("full_text"), read.alias("pages"))
    return evaluate(predictions, truth, found)


def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of evaluate() on turns of conversations, with their sample counts."""
    counts = ("ground_truth_pages", "prediction_pages", "layout_matches_iou50", "matched_table_pairs", "matched_cells", "reading_order_matched_blocks", "reading_order_inversions", "ground_truth_formulas", "matched_pii_entities")
    return _evaluated(spark, sf_dir).select("run_id", *METRICS, "text_edit_distance", *[F.col(c).cast("long").alias(c) for c in counts])


# -- gates ------------------------------------------------------------------------------


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def ground_truth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth payloads made of documents, one in nine of each broken kind."""
    text = F.to_json(F.struct(F.col("head").alias("t")))
    text = text.substr(F.lit(6), F.length(text) - 6)  # as a JSON string
    pages = lambda blocks: F.concat(F.lit('{"full_text": '), text, F.lit(', "pages": '), F.lit(blocks), F.lit("}"))
    shapes = [
        pages('[{"page_number": 1, "blocks": [{"type": "title", "text": "x", "reading_order": 0}]}]'),
        F.lit("[1, 2]"),
        F.lit('{"full_text": 5, "pages": {}}'),
        pages('[{"page_number": 0, "blocks": []}, {"page_number": "x", "blocks": 3}]'),
        pages('[{"blocks": [7, {"type": 1}, {"text": "t", "reading_order": "first"}]}]'),
        pages('[{"blocks": [{"cells": {}}, {"cells": [3, {"row": "a"}]}]}]'),
        F.concat(F.lit('{"full_text": "t", "pages": [], "pii_entities": [{"type": "EMAIL", "start": 5, "end": 5}]}')),
        F.lit('{"full_text": "t", "pages": [], "pii_entities": [{"start": 1}]}'),
        F.lit('{"full_text": "t", "pages": [], "pii_entities": "none"}'),
    ]
    rows = _docs(spark, sf_dir).select("doc_id", F.element_at(F.array(*shapes), (F.col("doc_id") % 9 + 1).cast("int")).alias("payload"))
    return _counted(gates.ground_truth_violations(rows, ["doc_id"]))


def case_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired-repair cases made of documents, broken in nine ways by number."""
    n = F.col("doc_id")
    docs = _docs(spark, sf_dir).withColumns({"case_id": n.cast("string"), "text": F.rpad("text", F.greatest(F.length("text"), F.lit(20)), F.lit("."))})
    block = lambda d, page, kind: docs.select("case_id", F.lit("b").alias("block_id"), d.alias("document_id"), page.alias("page_number"), "text", kind.alias("source_kind"), "doc_id")
    blocks = block(F.lit("d"), F.when(n % 11 == 1, 0).otherwise(1), F.when(n % 11 == 2, "scan").otherwise("canonical_parser"))
    blocks = blocks.unionByName(block(F.when(n % 11 == 4, "other").otherwise("d"), F.lit(1), F.lit("pypdf_page_text")).filter(n % 11 > 2).withColumn("block_id", F.when(n % 11 == 3, "b").otherwise("b2")))
    questions = docs.select("case_id", F.lit("q").alias("question_id"), F.when(n % 11 == 5, "other").otherwise("d").alias("document_id"), F.lit("?").alias("question"), "doc_id")
    questions = questions.unionByName(questions.filter(n % 11 == 6))
    edit = lambda name, start, end: docs.filter(n % 11 != 3).select("case_id", F.lit("b").alias("block_id"), F.lit(name).alias("candidate_id"), start.alias("start"), end.alias("end"), F.substring("text", start + 1, end - start).alias("before"), F.lit("<new>").alias("after"), F.when(n % 11 == 10, " ").otherwise("note").alias("source_note"), "doc_id")
    first = edit("A", F.lit(0), F.when(n % 11 == 7, 8).otherwise(2))
    second = edit("B", F.lit(5), F.when(n % 11 == 8, F.length("text") + 10).otherwise(9)).withColumn("before", F.when(n % 11 == 9, "??").otherwise(F.col("before")))
    return _counted(gates.case_violations(blocks.drop("doc_id"), questions.drop("doc_id"), first.unionByName(second).drop("doc_id")))


def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a question for each order, some missing, blank or with unknown evidence; their ids and payloads too."""
    n = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    questions = orders.select(n.cast("string").alias("question_id"), F.when(n % 13 == 0, "nowhere").otherwise("d").alias("document_id"))
    blocks = orders.select(n.cast("string").alias("block_id"), F.lit("d").alias("document_id"))
    answers = orders.filter(n % 5 != 0).select(n.cast("string").alias("question_id"), F.when(n % 7 == 0, " ").otherwise("yes").alias("answer"), F.array(n.cast("string"), F.when(n % 11 == 0, "gone").otherwise(n.cast("string"))).alias("evidence_block_ids"))
    tasks = tasks_for(orders)
    found = gates.answer_violations(answers, questions, blocks, tasks)
    payload = gates.payload_violations(blocks, questions, tasks)
    return _counted(found.select("rule").union(payload.select(F.concat(F.lit("payload_"), "rule").alias("rule"))))


def block_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks that name pages and ids of their own."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 2).alias("page_number"), (F.col("l_partkey") % 2).alias("own_page"), F.when(F.col("l_partkey") % 10 == 0, "").otherwise(F.concat(F.lit("b"), (n % 4).cast("string"))).alias("id"))
    return _counted(gates.canonical_violations(rows, ["run_id"]))


def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a grid of cases, repeats and conditions, made of events."""
    e = F.col("event_id")
    records = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("case_id"), (e % 3 + 1).cast("int").alias("repeat_id"), F.element_at(F.array(*map(F.lit, ("A", "B", "C"))), (F.col("user_id") % 3 + 1).cast("int")).alias("condition"), F.floor(e / 2).cast("string").alias("execution_id"), (e % 17 == 0).cast("string").alias("input_sha256"), F.lit("false").alias("expected_input_sha256"))
    cases = spark.range(25).select(F.col("id").cast("string").alias("case_id"))
    return _counted(gates.run_violations(records, cases, ["A", "B"], 2))


def judgment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of labels, some missing, unsigned, without verdict or of nothing."""
    d = F.col("doc_id")
    predictions = _table(spark, sf_dir, "documents").select(d.cast("string").alias("judgment_id"))
    judgments = _table(spark, sf_dir, "labels").select(F.when(d % 9 == 0, F.concat(F.lit("x"), d.cast("string"))).otherwise(d.cast("string")).alias("judgment_id"), F.when(d % 4 != 0, F.col("quality") == 1).alias("correct"), F.when(d % 6 == 0, " ").otherwise("judge").alias("judge_id"))
    manual = _table(spark, sf_dir, "labels").select(d.cast("string").alias("run_id"), F.lit("e").alias("evaluator_id"), (d % 7).cast("int").alias("text_score"), (d % 6).cast("int").alias("table_score"), F.lit(None).cast("int").alias("reading_order_score"), F.lit(5).alias("deidentification_score"), F.repeat(F.lit("n"), (d % 5000).cast("int")).alias("notes"))
    return _counted(gates.judgment_violations(predictions, judgments).select("rule").union(gates.manual_violations(manual).select("rule")))


def experiment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments of events with parsers and formats, and fields under two spellings."""
    u, e = F.col("user_id"), F.col("event_id")
    events = _table(spark, sf_dir, "events")
    runs = events.select(u.cast("string").alias("experiment_id"), (e % 40).cast("string").alias("parser_name"), F.element_at(F.array(*map(F.lit, ("PDF", "txt", "exe"))), (e % 3 + 1).cast("int")).alias("extension"), F.array(F.lit("pdf"), F.lit("txt")).alias("supported_formats"))
    fields = events.select(e.alias("id"), F.when(e % 4 != 0, F.concat(F.lit("v"), (e % 2).cast("string"))).alias("a"), F.when(e % 3 != 0, F.lit("v1")).alias("b"))
    return _counted(gates.experiment_violations(runs).select("rule").union(gates.alias_conflicts(fields, ["id"], "a", "b").select("rule")))


# -- answers, judgments and runs --------------------------------------------------------


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every condition joined with blind judgments by their ids, and summed up."""
    d = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    records = docs.select(F.col("source").alias("case_id"), F.lit(1).alias("repeat_id"), d.cast("string").alias("question_id"), F.lit("answer").alias("answer"), "doc_id", F.explode(F.array(*map(F.lit, repair.CONDITIONS))).alias("condition"))
    records = records.withColumn("execution_id", F.concat_ws("/", "case_id", "condition"))
    gold = docs.select(d.cast("string").alias("question_id"), F.lit("reference").alias("reference_answer"))
    sheet = repair.blind_sheet(records, gold)
    labels = records.select(stable_id(F.col("execution_id"), F.col("question_id")).alias("judgment_id"), ((d + F.length("condition")) % 3 != 0).alias("correct"))
    judgments = sheet.join(labels.hint("shuffle_hash"), "judgment_id").select("judgment_id", "correct")
    rows = repair.outcomes(repair.judged(records, judgments))
    return rows.select("case_id", "condition", "correct_count", "question_count", F.size("recovered_question_ids").cast("long").alias("n_recovered"), F.size("regressed_question_ids").cast("long").alias("n_regressed"), "net_recovery")


def judgment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of judgments, and places of needles that stand once in a text."""
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("judgment_id"), repair.unique_span(F.col("text"), F.lit("the ")).cast("long").alias("place"))


def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as JSON, fenced or broken, with the evidence that they cite."""
    n = F.col("o_orderkey")
    shapes = [
        F.concat(F.lit('{"answer": "yes", "evidence_chunk_ids": ["c'), (n % 3).cast("string"), F.lit('", "c1", "c1"]}')),
        F.concat(F.lit('```json\n{"answer": "no", "evidence_chunk_ids": ["c'), (n % 4).cast("string"), F.lit('"]}\n```')),
        F.lit("I think so"),
        F.lit('{"answer": "", "evidence_chunk_ids": []}'),
        F.lit('{"answer": "x", "evidence_chunk_ids": [1, 2]}'),
        F.lit('{"answer": "x", "evidence": []}'),
    ]
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", retrieval.parsed_answer(F.element_at(F.array(*shapes), (n % 6 + 1).cast("int")), F.array(*map(F.lit, ("c0", "c1", "c2")))).alias("p"))
    rows = rows.select("o_orderkey", "p.*")
    good = rows.filter("rule is null").select(n.cast("string").alias("question_id"), "evidence_chunk_ids")
    chunks = spark.range(3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.array(F.concat(F.lit("b"), F.col("id").cast("string")), F.lit("b9")).alias("source_block_ids"))
    cited = retrieval.evidence_blocks(good, chunks).select(F.col("question_id").cast("long").alias("o_orderkey"), F.array_join("evidence_block_ids", ",").alias("blocks"))
    return rows.select("o_orderkey", "rule").join(cited.hint("shuffle_hash"), "o_orderkey", "left")


def cited_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that marks in a text name."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("so [source:b"), (n % 5).cast("string"), F.lit("] and [source:b1]"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", retrieval.cited_sources(F.when(n % 2 == 0, text).otherwise(F.col("o_orderpriority")), F.array(*map(F.lit, ("b1", "b2", "b3")))).alias("s"))
    return rows.select("o_orderkey", F.array_join("s.source_block_ids", ",").alias("sources"), "s.lineage_mode")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (by + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        e.cast("string").alias("run_id"), F.col("user_id").cast("string").alias("experiment_id"), F.concat(F.lit("=parser"), (e % 4).cast("string")).alias("parser_name"), F.lit("1").alias("parser_version"),
        pick(e % 5, "SUCCEEDED", "RUNNING", "FAILED", "SUCCEEDED", "PENDING").alias("parse_status"), pick(e % 7, "NOT_REQUESTED", "FAILED", "RUNNING", "SUCCEEDED", "INTERRUPTED", "PENDING", "SUCCEEDED").alias("deidentification_status"),
        (e % 900).alias("latency_ms"), F.col("ts").alias("created_at"), e.alias("event_id"),
    )


def run_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate, mean latency, active and failed runs over all events."""
    return operations.board(_runs(spark, sf_dir)).select(F.round("success_rate", 6).alias("success_rate"), F.round("average_latency_ms", 6).alias("average_latency_ms"), "active_runs", "failed_runs")


def deidentified_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of experiments whose runs are de-identified, and of their runs."""
    runs = _runs(spark, sf_dir)
    status = operations.experiment_status(runs.select("experiment_id").distinct(), runs).select("experiment_id", "status", F.round("progress", 6).alias("progress"))
    shown = runs.groupBy("experiment_id").agg(
        F.count_if(operations.display_status(F.col("parse_status"), F.col("deidentification_status")) == "RUNNING").alias("shown_running"),
        F.count_if(operations.retry_stage(F.col("parse_status"), F.col("deidentification_status"), F.col("event_id") % 2 == 0) == "parse").alias("retry_parse"),
        F.count_if(operations.retry_stage(F.col("parse_status"), F.col("deidentification_status"), F.col("event_id") % 2 == 0) == "deidentification").alias("retry_deidentification"),
    )
    return status.join(shown.hint("shuffle_hash"), "experiment_id")


def preferred_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preferred run of each experiment and evaluator: the newest that was marked."""
    runs = _runs(spark, sf_dir)
    manual = runs.select("run_id", "experiment_id", (F.col("event_id") % 2).cast("string").alias("evaluator_id"), (F.col("event_id") % 3 == 0).alias("is_preferred"), F.col("created_at").alias("updated_at"))
    return operations.exclusive_preference(manual).filter("is_preferred").select("experiment_id", "evaluator_id", "run_id")


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with result sizes, de-identification counts and one evaluator's scores, as the CSV export has them."""
    e = F.col("event_id")
    runs = _runs(spark, sf_dir)
    artifact = lambda path, size: F.struct(F.lit("n").alias("name"), path.alias("path"), F.lit("text/plain").alias("media_type"), size.cast("long").alias("size_bytes"), F.lit("s").alias("source"), F.lit(False).alias("archive_entry"))
    results = runs.filter(e % 3 != 0).select("run_id", (e % 9).cast("int").alias("page_count"), (e % 77).cast("int").alias("text_length"), F.lit(1).alias("block_count"), F.lit(0).alias("table_count"), F.lit(2).alias("image_count"), F.array(artifact(F.lit("p"), e), artifact(F.lit("p"), e), artifact(F.lit("q"), e % 10)).alias("artifact_manifest"))
    deidentified = runs.filter(e % 4 == 0).select("run_id", (e % 5).cast("int").alias("detected_entity_count"), (e % 3).cast("int").alias("masked_entity_count"))
    manual = runs.filter(e % 2 == 0).select("run_id", F.when(e % 6 == 0, "other").otherwise("me").alias("evaluator_id"), (e % 5 + 1).cast("int").alias("text_score"), F.lit(None).cast("int").alias("table_score"), F.lit(None).cast("int").alias("reading_order_score"), F.lit(None).cast("int").alias("deidentification_score"), (e % 10 == 0).alias("is_preferred"), F.lit("-note").alias("notes"), "created_at").withColumnRenamed("created_at", "updated_at")
    rows = compare.csv_rows(compare.comparison(runs, results, deidentified, manual, "me"))
    return rows.withColumnRenamed(rows.columns[0], "run_id").select("run_id", "parser_name", "latency_ms", F.col("page_count").cast("long").alias("page_count"), "result_size_bytes", F.col("detected_entity_count").cast("long").alias("detected_entity_count"), F.col("text_score").cast("long").alias("text_score"), "is_preferred", "notes")


def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document by the lines of its text doubled with blanks between: the numbers of those without text."""
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n \n")), "\n", -1)
    pages = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(lines).alias("at", "text")).withColumn("page_number", F.col("at") + 1)
    found = structure.empty_pages(pages).select("document_id", F.array_join(F.col("empty_pages").cast("array<string>"), ",").alias("empty_pages"))
    whole = structure.assemble_text(pages.filter(F.trim("text") != ""), ["document_id"]).select("document_id", F.md5("full_text").alias("text_md5"))
    return whole.join(found.hint("shuffle_hash"), "document_id", "left")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table blocks of documents with two cells at one place, of which the last stays, by ordinal and row."""
    cell = lambda row, column, text: F.struct(F.lit(row).alias("row"), column.alias("column"), F.lit(None).cast("int").alias("row_span"), F.lit(None).cast("int").alias("column_span"), text.alias("text"))
    table = lambda name: F.struct(F.lit(name).alias("id"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("reading_order"), F.lit("").alias("text"), F.lit(None).cast("string").alias("html"), F.array(cell(0, F.lit(1), F.col("lang")), cell(0, F.lit(1), F.col("source")), cell(1, (F.col("doc_id") % 3).cast("int"), F.col("lang"))).alias("cells"))
    docs = _table(spark, sf_dir, "documents").withColumn("pages", F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.array(table("t"), table("u")).alias("blocks"))))
    grid = structure.table_grid(structure.cells_of(structure.tables_of(docs, ["doc_id"]), ["doc_id"]), ["doc_id"])
    return grid.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("row").cast("long").alias("row"), F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["column"].cast("string"), c["row_span"].cast("string"), c["text"])), ",").alias("cells"))


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated and skipped runs of each parser."""
    runs = _runs(spark, sf_dir)
    return benchmark.recompute_report(runs, runs.filter("event_id % 3 = 0").select("run_id"), ["parser_name"])


def token_counts_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and token counts by priority."""
    n = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderpriority", (n % 100).alias("input_tokens"), F.when(n % 3 != 0, n % 7).alias("output_tokens"), (n % 11).alias("total_tokens"))
    return operations.token_usage(rows, ["o_orderpriority"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tree_results, pipeline_results, content_list_results, plain_results, vendor_masks, evaluation_scores, ground_truth_gate, case_gate, answer_gate, block_gate,
        run_gate, judgment_gate, experiment_gate, judged_answers, judgment_ids, cited_evidence, cited_marks, run_board, deidentified_statuses, preferred_runs,
        side_by_side, blank_pages, table_rows, recomputed, token_counts_of_answers,
    )
}
