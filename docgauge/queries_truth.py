"""JSON payloads to scores, and the measures behind them, as queries over the shared tables.

Orders are documents, their lines are blocks: ground truth and what a parser read are written
as JSON payloads, with aliases and odd forms, and read back by the payload reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.functions.distances import distance
from docgauge.functions.frames import dealt, tasks_for
from docgauge.operators import metrics, structure
from docgauge.plans.evaluate import evaluate
from docgauge.schemas import ENTITIES
from docgauge.sources import payloads
from docgauge.streaming import scoring


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks: place, size and text of each follow from the line.  Dealt by document, so that payloads are made, read and joined where the lines lie."""
    lines = Window.partitionBy("document_id").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = table.select(F.col("l_orderkey").cast("string").alias("document_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    rows = dealt(rows, tasks_for(table), "document_id").withColumn("k", F.row_number().over(lines))
    k, part, supplier = F.col("k"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    return rows.select(
        "document_id", k.alias("k"), part.alias("part"), supplier.alias("supplier"),
        (part % 10 + 10).alias("n"), (supplier % 9).alias("high"), (part % 7 + supplier % 3).alias("shift"), (supplier % 30).alias("added"), (part % 50).alias("place"),
        F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus"), F.lit(" AIR")).alias("mode"), F.concat(F.lit("part "), part.cast("string")).alias("note"),
    )


def _fields(**values: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in values.items()])


def _gathered(rows: DataFrame, item: Column) -> Column:
    """JSON texts of a document's items in order of line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json(item).alias("json")))), lambda x: x["json"]), ", ")


def truth_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, payload: two pages of paragraphs (boxes as objects under another name), a table on a third, entities under labels; one in ten is broken."""
    rows = _lines(spark, sf_dir)
    k = F.col("k")
    letter = F.char(k + 96)
    box = _fields(x1=F.lit(0), y1=k * 10, x2=F.lit("100"), y2=k * 10 + 10 + F.col("high"))
    block = _fields(type=F.lit("paragraph"), text=F.repeat(letter, F.col("n")), reading_order=k, bounding_box=box)
    cells = F.array(_fields(row_index=k, column_index=F.lit(0), text=F.col("mode")), _fields(row_index=k, column_index=F.lit(1), text=F.col("note")))
    cell = lambda i: F.to_json(F.get(cells, F.lit(i)))
    entity = _fields(label=F.lit("LINE"), start=(k * 5).cast("string"), end=k * 5 + 3)
    page = lambda odd: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(k % 2 == odd, F.struct("k", F.to_json(block).alias("json"))))), lambda x: x["json"]), ", ")
    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(", ", cell(0), cell(1)).alias("json")))), lambda x: x["json"]), ", ")
    made = rows.groupBy("document_id").agg(page(1).alias("odd"), page(0).alias("even"), table.alias("cells"), _gathered(rows, entity).alias("entities"), F.sort_array(F.collect_list("mode")).alias("modes"))
    return made.select(
        "document_id",
        F.concat(
            F.lit('{"full_text": "'), F.array_join("modes", " "), F.lit('", "pages": ['), F.when(F.col("document_id") % 10 == 0, '"no page", ').otherwise(""), F.lit('{"blocks": ['), "odd", F.lit(']}, {"page_number": "2", "blocks": ['), "even",
            F.lit(']}, {"blocks": [{"type": "table", "cells": ['), "cells", F.lit(']}]}], "pii_entities": ['), "entities", F.lit("]}"),
        ).alias("payload"),
    )


def read_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, document_id, payload: what a parser read: texts with letters added, boxes moved, lines in another order, some cells gone or changed."""
    rows = _lines(spark, sf_dir)
    k = F.col("k")
    top = k * 10 + F.col("shift")
    block = _fields(type=F.lit("paragraph"), text=F.concat(F.repeat(F.char(k + 96), F.col("n")), F.repeat(F.lit("z"), F.col("added"))), reading_order=F.col("place"), bbox=F.array(F.lit(0), top, F.lit(100), top + 12))
    page = lambda odd: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(k % 2 == odd, F.struct("k", F.to_json(block).alias("json"))))), lambda x: x["json"]), ", ")
    name = F.when(F.col("part") % 3 == 0, F.lower("mode")).otherwise(F.col("mode"))
    cells = F.concat_ws(", ", F.to_json(_fields(row=k.cast("string"), column=F.lit(0), col_span=F.lit(1), text=name)), F.when(k % 4 != 0, F.to_json(_fields(row=k, column=F.lit(1), text=F.col("note")))))
    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", cells.alias("json")))), lambda x: x["json"]), ", ")
    made = rows.groupBy("document_id").agg(page(1).alias("odd"), page(0).alias("even"), table.alias("cells"), F.sort_array(F.collect_list(name)).alias("modes"))
    return made.select(
        F.concat(F.lit("r"), "document_id").alias("run_id"), "document_id",
        F.concat(F.lit('{"full_text": "'), F.array_join("modes", " "), F.lit('", "pages": ["no page", {"blocks": ['), "odd", F.lit(']}, {"blocks": [7'), F.when(F.col("even") != "", F.concat(F.lit(", "), "even")).otherwise(""),
            F.lit(']}, 5, {"blocks": [{"type": "table", "cells": ['), "cells", F.lit(', {"row": "x"}, 3]}]}]}')
        ).alias("payload"),
    )


def truth_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth payloads as a row for each block."""
    truth, _ = payloads.ground_truth(truth_payloads(spark, sf_dir), "orders", "1")
    blocks = structure.blocks_of(truth, ["document_id"])
    whole = lambda c: F.col(c).cast("long").alias(c)
    return blocks.select("document_id", whole("page_number"), whole("source_index"), "type", "text", whole("reading_order"), F.col("bbox.y1").alias("top"), F.col("bbox.y2").alias("bottom"), F.size(F.coalesce("cells", F.array().cast("array<struct<row: int, column: int, row_span: int, column_span: int, text: string>>"))).cast("long").alias("n_cells"))


def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of both sides to the scores of every run: text, layout with boxes that compete, cells, reading order of edited texts."""
    truth, _ = payloads.ground_truth(truth_payloads(spark, sf_dir), "orders", "1", kept=False)
    read = payloads.typed(read_payloads(spark, sf_dir), ["run_id", "document_id"], kept=False).drop("pii_entities")
    scores = evaluate(read, truth)
    counts = ("layout_matches_iou50", "ground_truth_cells", "prediction_cells", "matched_cells", "reading_order_matched_blocks", "reading_order_inversions", "ground_truth_pii_entities")
    measured = ("text_cer", "page_count_accuracy", "layout_precision_iou50", "layout_recall_iou50", "layout_f1_iou50", "layout_mean_iou", "table_structure_precision", "table_structure_recall", "table_content_accuracy", "reading_order_accuracy", "reading_order_coverage")
    return scores.select("run_id", *measured, *[F.col(c).cast("long").alias(c) for c in counts])


def crossed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every supplier in two orders: how many pairs cross."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rest = ("l_linenumber", "l_partkey", "l_extendedprice")
    place = lambda *by: F.row_number().over(Window.partitionBy("supplier").orderBy(*by))
    places = rows.select("supplier", place("l_orderkey", *rest).alias("p"), place("l_partkey", "l_orderkey", *rest).alias("g"))
    return metrics.inversions(places, ["supplier"])


def part_name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edit distances between the names of parts that follow each other, with bounds of the third."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    pairs = parts.join(parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")).hint("shuffle_hash"), "p_partkey")
    rows = pairs.withColumns({kind: distance(F.col("p_name"), F.col("next"), kind) for kind in ("levenshtein", "indel", "gaps")})
    return rows.select("p_partkey", "levenshtein", "indel", F.col("gaps").between(F.col("levenshtein"), F.col("indel")).alias("gaps_between"))


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a stream of results in two versions, joined with a stream of ground truth (every a a b); the last scores of each run."""
    kind = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    source = spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations.parquet*")
    turns = source.select(F.concat_ws("-", "conv_id", "turn").alias("document_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    versions = turns.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.when(F.col("version") == 1, F.lit("draft")).otherwise(F.col("full_text"))
    results = versions.select(F.concat(F.lit("r"), "document_id").alias("run_id"), "document_id", "version", text.alias("full_text"), structure.text_pages(text).alias("pages"))
    gold = F.replace("full_text", F.lit("a"), F.lit("b"))
    truth = turns.select("document_id", F.lit(1).alias("version"), gold.alias("full_text"), structure.text_pages(gold).alias("pages"), F.array().cast(ENTITIES).alias("pii_entities"))
    path = scoring.shared_path(spark, "scores")
    scoring.score_joined(results, truth, path, f"{path}-checkpoint").awaitTermination()
    scores = scoring.current_scores(spark.read.parquet(path))
    return scores.select("run_id", "document_id", F.col("run_version").cast("long").alias("run_version"), "text_edit_distance", F.col("ground_truth_characters").cast("long").alias("ground_truth_characters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (truth_blocks, payload_scores, crossed_lines, part_name_distances, streamed_scores)}
