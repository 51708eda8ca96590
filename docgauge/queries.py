"""The library's operators as queries over the shared tables, each with the same in SQL where SQL can say it.

The tables hold no parser results, so they are derived: documents are ground truth, their
text variants are predictions of three parsers, events are runs, boxes and cells follow
from the numbers of lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.columns import csv_safe, f1_scores, normalize_space, normalize_text, tidy, tokens
from docgauge.functions.frames import tasks_for
from docgauge.operators import benchmark, compare, gates, masking, metrics, normalize, operations, repair, retrieval, structure

LETTERS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Event types as run statuses.
STATUS = {"click": "SUCCEEDED", "purchase": "SUCCEEDED", "view": "RUNNING", "signup": "PENDING", "error": "FAILED"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- documents as canonical documents -------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("full_text"), "lang", "source", "doc_id")
    return rows.withColumn("pages", structure.text_pages(F.col("full_text"), separator="\n"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into paragraph blocks, one row each, by number and length."""
    blocks = structure.blocks_of(_documents(spark, sf_dir), ["doc_id"])
    return blocks.select("doc_id", F.col("id").alias("block_id"), F.col("reading_order").cast("long").alias("reading_order"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("run_id", F.col("document_id"))
    made = structure.run_summary(docs)
    return made.select("run_id", F.md5("preview").alias("preview_md5"), *[F.col(c).cast("long").alias(c) for c in ("text_length", "page_count", "block_count", "table_count", "image_count")])


def parser_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic parses of every document."""
    rows = normalize.variants(_documents(spark, sf_dir), "full_text")
    return rows.select("doc_id", "parser_name", F.length("parsed_text").cast("long").alias("n_chars"), F.md5("parsed_text").alias("text_md5"))


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which an address was masked."""
    rows = _documents(spark, sf_dir).select("doc_id", "full_text", masking.masked(F.col("full_text")).alias("masked_text"))
    return rows.filter("full_text <> masked_text").select("doc_id", F.length("masked_text").cast("long").alias("n_chars"), F.md5("masked_text").alias("masked_md5"))


def segments_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of at most 1000 characters of every document."""
    rows = _documents(spark, sf_dir).select("doc_id", F.col("document_id").alias("block_id"), F.col("full_text").alias("text"))
    cut = retrieval.segments(rows, 1000)
    return cut.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("segment").alias("segment_md5"))


def synthesis_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a document packed into batches of 4000 characters, with headers."""
    rows = _documents(spark, sf_dir).select("doc_id", F.col("document_id").alias("block_id"), F.col("full_text").alias("text"))
    packed = retrieval.batches(retrieval.segments(rows, 1000), ["doc_id"], ["segment_at"], 4000)
    return packed.groupBy("doc_id", "batch").agg(F.count("*").alias("n_segments"), F.sum(F.length("segment")).alias("n_chars")).withColumn("batch", F.col("batch").cast("long"))


def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "document_id", F.lit("b").alias("block_id"), F.col("full_text").alias("text"))
    return retrieval.passthrough(rows).select("doc_id", "chunk_at", "start", "end", F.md5("chunk").alias("chunk_md5"))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every benchmark item."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    corpus = _documents(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), F.col("full_text").alias("text"))
    top = retrieval.bm25(queries, corpus, 5, fill=False)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and how many documents hold them."""
    rows = _documents(spark, sf_dir).select(tokens(F.col("full_text")).alias("tokens"))
    each = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("df")))
    # Both counts add up before the shuffle; no pair of token and document is sent.
    return rows.select(F.explode(F.concat(each, once)).alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n"), F.sum("c.df").alias("df"))


def empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one line each: the numbers of the empty ones."""
    lines = _documents(spark, sf_dir).select("document_id", F.posexplode(F.split("full_text", "\n", -1)).alias("at", "text")).withColumn("page_number", F.col("at") + 1)
    return structure.empty_pages(lines).select("document_id", F.array_join(F.col("empty_pages").cast("array<string>"), ",").alias("empty_pages"))


# -- text pairs: turns of a conversation ----------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("base"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("base").alias("target"))
    return a.join(b.hint("merge"), ["conv_id", "turn"])


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation scored against the next: CER, accuracy, exact match, of their ASCII characters; whole_text_scores takes whole texts."""
    ascii_only = lambda c: normalize_space(F.regexp_replace(c, r"[^\x20-\x7e]+", " "))
    pairs = _turns(spark, sf_dir).select("conv_id", "turn", ascii_only("base").alias("reference"), ascii_only("target").alias("predicted"))
    rows = metrics.text_metrics(pairs)
    return rows.select("conv_id", "turn", "text_edit_distance", tidy(F.col("text_cer")).alias("text_cer"), tidy(F.col("text_accuracy")).alias("text_accuracy"), "text_exact_match")


def whole_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As text_scores, of the whole texts (NFKC, white space as one space)."""
    pairs = _turns(spark, sf_dir).select("conv_id", "turn", normalize_text("base").alias("reference"), normalize_text("target").alias("predicted"))
    rows = metrics.text_metrics(pairs)
    return rows.select("conv_id", "turn", "text_edit_distance", tidy(F.col("text_cer")).alias("text_cer"), tidy(F.col("text_accuracy")).alias("text_accuracy"), "text_exact_match")


def turn_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between successive turns."""
    rows = compare.text_diffs(_turns(spark, sf_dir))
    return rows.select("conv_id", "turn", "similarity_ratio", "added_count", "removed_count", F.size("diff").alias("n_parts"))


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its numbered-lines variant."""
    rows = normalize.variants(_documents(spark, sf_dir), "full_text").filter("parser_name = 'line_numbered'")
    return compare.text_diffs(rows.select("doc_id", F.col("full_text").alias("base"), F.col("parsed_text").alias("target"))).select("doc_id", "similarity_ratio", "added_count", "removed_count")


# -- layout, tables, entities from lineitem -------------------------------------------


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order as a run, its lines as blocks of a page by ship mode; predictions are moved by the discount."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_discount")])
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.lit(1).alias("page_number"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").cast("int").alias("index"),
        (F.col("l_linenumber") * 100).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w"), (F.round(F.col("l_discount") * 100) / 4).cast("double").alias("moved"),
    )
    box = lambda x: F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + F.col("w")).alias("x2"), F.lit(10.0).alias("y2"))
    keys = ["run_id", "page_number", "type", "index"]
    return rows.select(*keys, box(F.col("x")).alias("bbox")), rows.select(*keys, box(F.col("x") + F.col("moved")).alias("bbox"))


def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box precision, recall, F1 and mean IoU of every order."""
    rows = metrics.layout_metrics(*_boxes(spark, sf_dir))
    counts = ["layout_ground_truth_blocks", "layout_prediction_blocks", "layout_matches_iou50"]
    return rows.select("run_id", *counts, *[tidy(F.col(c)).alias(c) for c in ("layout_precision_iou50", "layout_recall_iou50", "layout_f1_iou50", "layout_mean_iou")])


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.lit(0).alias("ordinal"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("column"),
        F.lit(1).alias("row_span"), F.lit(1).alias("column_span"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
    )
    truth = rows.filter("part % 7 <> 0").drop("part", "flag")
    return truth, rows.filter("part % 5 <> 0").withColumn("text", F.concat("text", F.when(F.col("flag") == "R", "!").otherwise(""))).drop("part", "flag")


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell structure and content scores of every order."""
    rows = metrics.cell_metrics(*_cells(spark, sf_dir))
    counts = ["matched_cells", "ground_truth_cells", "prediction_cells"]
    return rows.select("run_id", *counts, *[tidy(F.col(c)).alias(c) for c in ("table_structure_precision", "table_structure_recall", "table_structure_f1", "table_content_accuracy")])


def table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All table scores of every order, the tree similarity included."""
    truth, found = _cells(spark, sf_dir)
    tables = lambda cells: cells.select("run_id", "ordinal").distinct()
    rows = metrics.table_metrics(tables(truth), tables(found), truth, found)
    return rows.select("run_id", "ground_truth_tables", "prediction_tables", tidy(F.col("table_teds")).alias("table_teds"), tidy(F.col("table_teds_structure")).alias("table_teds_structure"))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span scores of every order."""
    lines = _table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("type"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("end"), "l_partkey", "l_suppkey")
    found = metrics.entity_metrics(rows.filter("l_partkey % 3 <> 0"), rows.filter("l_suppkey % 4 <> 0"), tasks_for(lines))
    counts = ["ground_truth_pii_entities", "prediction_pii_entities", "matched_pii_entities"]
    return found.select("run_id", *counts, *[tidy(F.col(c)).alias(c) for c in ("pii_precision", "pii_recall", "pii_f1", "pii_leakage_rate", "pii_overmask_rate")])


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of every order's lines, predicted by ship date."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.lit(1).alias("page_number"), F.col("l_returnflag").alias("type"), "l_linenumber", "l_shipdate", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    from pyspark.sql import Window

    number = lambda *by: (F.row_number().over(Window.partitionBy("run_id").orderBy(*by)) - 1).alias("position")
    keys = ["run_id", "page_number", "type"]
    found = metrics.order_metrics(rows.select(*keys, number("l_linenumber"), "text"), rows.select(*keys, number("l_shipdate", "l_linenumber"), "text"))
    return found.select("run_id", "reading_order_matched_blocks", "reading_order_inversions", tidy(F.col("reading_order_accuracy")).alias("reading_order_accuracy"))


# -- events as runs --------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("experiment_id"), (F.col("user_id") % 50).cast("string").alias("document_id"),
        F.concat(F.lit("parser"), (F.col("event_id") % 4).cast("string")).alias("parser_name"), F.lit("1").alias("parser_version"), F.concat(F.lit('{"mode": '), (F.col("event_id") % 2).cast("string"), F.lit("}")).alias("config"),
        F.coalesce(F.element_at(status, F.col("event_type")), F.lit("SUCCEEDED")).alias("parse_status"), F.lit("NOT_REQUESTED").alias("deidentification_status"), (F.floor(F.col("value") * 10) + 1).cast("long").alias("latency_ms"), F.col("ts").alias("created_at"),
    )


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    n = F.col("run_id").cast("long")
    scores = runs.select("run_id", ((n * 37 % 101) / 100).alias("text_accuracy"), ((n * 53 % 151) / 100).alias("text_cer"), F.when(n % 3 == 0, (n * 17 % 101) / 100).alias("overall_quality"))
    results = runs.select("run_id", (n % 9 + 1).cast("int").alias("page_count"))
    truth = runs.select("document_id").distinct().select("document_id", F.lit("set").alias("dataset_name"), (F.col("document_id").cast("long") % 3).cast("string").alias("dataset_version"))
    return benchmark.evaluations(runs, truth, results, scores)


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95 % interval of every metric, by parser, version and configuration."""
    rows = benchmark.metric_intervals(_evaluated(spark, sf_dir), ["text_accuracy", "text_cer", "overall_quality"])
    return rows.select("parser_name", "parser_version", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")], (F.col("config_hash") == benchmark.config_hash(F.lit('{"mode":0}'))).alias("first_config"))


def operations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles, pages a minute and dataset versions of every group, ranked by quality."""
    evaluated = _evaluated(spark, sf_dir)
    quality = evaluated.groupBy(*benchmark.GROUP).agg(F.avg("overall_quality").alias("overall_quality"))
    rows = benchmark.leaderboard(benchmark.operations(evaluated).join(quality.hint("merge"), benchmark.GROUP))
    return rows.select("parser_name", "n_runs", "n_documents", *[F.round(c, 4).alias(c) for c in ("latency_p50", "latency_p95", "pages_per_minute")], F.array_join("dataset_versions", ",").alias("dataset_versions"), F.col("rank").cast("long").alias("rank"))


def recent_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fifty evaluations (a report, hence the limit)."""
    return benchmark.recent(_evaluated(spark, sf_dir)).select("run_id", "document_id", "parser_name", "text_accuracy")


def experiment_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    rows = operations.experiment_status(runs.select("experiment_id").distinct(), runs)
    return rows.select("experiment_id", "status", "n_runs", "n_succeeded", F.round("progress", 6).alias("progress"))


def operations_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and latency by parser, with the share that succeeded."""
    runs = _runs(spark, sf_dir)
    by = operations.by_parser(runs)
    return by.select("parser_name", "n_runs", F.round("average_latency_ms", 6).alias("average_latency_ms"))


def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the seven days up to the last event, zero where nothing ran."""
    runs = _runs(spark, sf_dir)
    last = runs.agg(F.max(F.to_date("created_at"))).first()[0]
    return operations.daily_histogram(runs, F.lit(last)).withColumn("day", F.col("day").cast("string"))


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of every experiment."""
    return operations.latest(_runs(spark, sf_dir), ["experiment_id"], "created_at", "run_id").select("experiment_id", "run_id", "parse_status")


# -- paired repair ---------------------------------------------------------------------


def _case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a case: its first character and, from 11 characters on, its sixth to tenth are repaired."""
    blocks = _documents(spark, sf_dir).select(F.col("document_id").alias("case_id"), F.lit("b").alias("block_id"), "document_id", F.lit(1).alias("page_number"), F.col("full_text").alias("text"))
    edit = lambda name, start, end, after: F.struct(F.lit(name).alias("candidate_id"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.substring("text", start + 1, end - start).alias("before"), F.lit(after).alias("after"))
    edits = F.when(F.length("text") > 10, F.array(edit("A", 0, 1, "<first>"), edit("B", 5, 10, ""))).when(F.length("text") > 0, F.array(edit("A", 0, 1, "<first>")))
    repairs = blocks.select("case_id", "block_id", F.explode(edits).alias("e")).select("case_id", "block_id", "e.*", F.lit("derived").alias("source_note"))
    return blocks, repairs


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the five conditions."""
    rows = repair.repaired_blocks(*_case(spark, sf_dir))
    return rows.select("case_id", "condition", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def inverse_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs that undo the repairs."""
    rows = repair.inverse_repairs(_case(spark, sf_dir)[1])
    return rows.select("case_id", "candidate_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "before", "after")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as questions: the source's quality judged under every condition."""
    docs = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source").hint("merge"), "doc_id")
    names = list(repair.CONDITIONS)
    rows = docs.select(F.col("source").alias("case_id"), F.lit(1).alias("repeat_id"), F.col("doc_id").cast("string").alias("question_id"), "quality", "toxic", F.col("doc_id").alias("d"), F.explode(F.array(*map(F.lit, names))).alias("condition"))
    correct = F.when(F.col("condition") == "A", (F.col("quality") == 1) | (F.col("d") % 2 == 0)).when(F.col("condition") == "B", (F.col("quality") == 1) & (F.col("toxic") == 0)).when(F.col("condition") == "AB", F.col("d") % 3 != 0).otherwise(F.col("quality") == 1)
    return rows.withColumn("correct", correct)


def repair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers recovered and lost by condition."""
    rows = repair.outcomes(_judged(spark, sf_dir))
    return rows.select("case_id", "condition", "correct_count", "question_count", F.round("accuracy", 6).alias("accuracy"), F.size("recovered_question_ids").cast("long").alias("n_recovered"), F.size("regressed_question_ids").cast("long").alias("n_regressed"), "net_recovery")


def repair_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.interactions(repair.outcomes(_judged(spark, sf_dir))).select("case_id", "interaction_count", "no_op_net_change")


def repair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that break the rules: here the short documents with one repair only."""
    blocks, repairs = _case(spark, sf_dir)
    blocks = blocks.withColumn("source_kind", F.lit("canonical_parser"))
    questions = blocks.select("case_id", F.lit("q").alias("question_id"), "document_id", F.lit("?").alias("question"))
    return gates.case_violations(blocks, questions, repairs).groupBy("rule").agg(F.count("*").alias("n"))


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of orders, safe for spreadsheets."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", csv_safe(F.concat(F.substring(F.lit("=+-@x"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1)), F.col("o_orderpriority"))).alias("safe"))


def leaderboard_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three parses of every document scored per paragraph against the document, summed up per parser with intervals.

    A paragraph counts as recovered where the parse has it word for word.
    """
    lines = lambda text: F.array_distinct(F.filter(F.transform(F.split(text, "\n"), normalize_space), lambda t: t != ""))
    docs = _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("full_text"))
    # The document's own lines are taken once, before its variants.
    rows = normalize.variants(docs.withColumn("g", lines(F.col("full_text"))), "full_text")
    # All paragraphs of a run stand in one row, so nothing is shuffled before the summary.
    both = rows.select("parser_name", "g", lines(F.col("parsed_text")).alias("p"))
    per_run = both.select("parser_name", F.size("g").alias("g"), F.size("p").alias("p"), F.size(F.array_intersect("g", "p")).alias("tp")).filter("g + p > 0")
    tp = F.col("tp")
    _, recall, f1 = f1_scores(tp, F.col("p") - tp, F.col("g") - tp)
    summary = benchmark.metric_intervals(per_run.select("parser_name", recall.alias("recall"), f1.alias("f1")), ["recall", "f1"], keys=["parser_name"])
    return summary.select("parser_name", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        leaderboard_of_variants, text_blocks, run_summaries, parser_variants, masked_documents, segments_and_chunks, synthesis_batches, overlapping_chunks, bm25_top,
        corpus_statistics, empty_lines, text_scores, whole_text_scores, turn_diffs, document_diffs, layout_scores, cell_scores, table_scores, entity_scores, order_scores,
        metric_summary, operations_summary, recent_evaluations, experiment_statuses, operations_board, daily_runs, latest_runs, repaired_texts,
        inverse_edits, repair_outcomes, repair_interactions, repair_gate, csv_guard,
    )
}
