"""Pages, blocks and tables of canonical documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.schemas import BLOCK, PAGES


def paragraphs(text: Column, separator: str = r"\n\s*\n", confidence: float | None = None) -> Column:
    """Blocks of a plain text: one paragraph for each part that isn't blank, ids block-1, block-2, ..."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda p: p != "")
    none = F.lit(None)
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.concat(F.lit("block-"), (i + 1).cast("string")).alias("id"), F.lit("paragraph").alias("type"), F.lit(1).alias("page_number"), i.alias("reading_order"), p.alias("text"),
            none.alias("bbox"), F.lit(confidence).alias("confidence"), none.alias("html"), none.alias("latex"), none.alias("cells"), none.alias("attributes"),
        ),
    ).cast(f"array<{BLOCK}>")


def text_pages(text: Column, **options) -> Column:
    """One page that holds a plain text, none for an empty one; pages as evaluate() takes them."""
    none = F.lit(None)
    page = F.struct(F.lit(1).alias("page_number"), none.alias("width"), none.alias("height"), text.alias("text"), paragraphs(text, **options).alias("blocks"))
    return F.when(text != "", F.array(page)).otherwise(F.slice(F.array(page), 1, 0)).cast(PAGES)


def each_of(rows: DataFrame, kept: list, items: str, at: str, item: str) -> DataFrame:
    """kept, place (from 0) and item of every item of an array column; none for a null or an empty array.

    Behind a plain explode Spark infers a filter on the size of the array and pushes it down to
    the scan, with all expressions that the array is made of written out in it again and again.
    """
    return rows.select(*kept, F.posexplode_outer(items).alias(at, item)).filter(F.col(at).isNotNull())


def pages_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each page: keys, page_at (from 0), page."""
    return each_of(docs, keys, "pages", "page_at", "page").withColumn("page_number", F.coalesce(F.col("page.page_number"), F.col("page_at") + 1))


def blocks_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block: keys, page_number, page_at, source_index and the fields of the block."""
    rows = each_of(pages_of(docs, keys), [*keys, "page_number", "page_at"], "page.blocks", "source_index", "block")
    fields = [f for f in rows.schema["block"].dataType.names if f != "page_number"]
    return rows.select(*keys, "page_number", "page_at", "source_index", *[F.col(f"block.{f}").alias(f) for f in fields])


def in_reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds position: place of the block by page, reading order (else source index) and source index."""
    order = Window.partitionBy(*keys).orderBy("page_number", F.coalesce("reading_order", "source_index"), "page_at", "source_index")
    return blocks.withColumn("position", F.row_number().over(order) - 1)


def running_number(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds running: number of the block over all pages, from 0."""
    return blocks.withColumn("running", F.row_number().over(Window.partitionBy(*keys).orderBy("page_at", "source_index")) - 1)


def tables_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Table blocks with their ordinal (from 0) in the document."""
    order = Window.partitionBy(*keys).orderBy("page_at", "source_index")
    return blocks_of(docs, keys).filter("type = 'table'").withColumn("ordinal", F.row_number().over(order) - 1)


def extract_tables(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_id, page_number, text, html, cells of every table block."""
    return tables_of(docs, keys).select(*keys, F.col("id").alias("block_id"), "page_number", "text", "html", "cells")


def cells_of(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, row, column, row_span, column_span, text; of cells at one place the last stays."""
    each = tables.select(*keys, "ordinal", F.posexplode("cells").alias("at", "cell"))
    place = [F.coalesce(F.col(f"cell.{c}"), F.lit(d)).alias(c) for c, d in (("row", 0), ("column", 0), ("row_span", 1), ("column_span", 1))]
    return each.groupBy(*keys, "ordinal", *place).agg(F.max_by("cell.text", "at").alias("text"))


def table_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tables with their cells in order of column."""
    return cells.groupBy(*keys, "ordinal", "row").agg(F.array_sort(F.collect_list(F.struct("column", "row_span", "column_span", "text"))).alias("cells"))


def page_text_lengths(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.struct(p["page_number"].alias("page_number"), F.length(p["text"]).alias("length")))


def run_summary(docs: DataFrame, preview: int = 1000) -> DataFrame:
    """run_id, preview, text_length, page_count, block_count, table_count, image_count."""
    blocks = F.flatten(F.transform("pages", lambda p: F.coalesce(p["blocks"], F.array())))
    of = lambda kind: F.size(F.filter(blocks, lambda b: b["type"] == kind))
    return docs.select(
        "run_id",
        F.left("full_text", F.lit(preview)).alias("preview"),
        F.length("full_text").alias("text_length"),
        F.size("pages").alias("page_count"),
        F.size(blocks).alias("block_count"),
        of("table").alias("table_count"),
        of("image").alias("image_count"),
    )


def research_blocks(docs: DataFrame) -> DataFrame:
    """Flat research blocks of canonical documents; a page without blocks but with text becomes one block."""
    whole = F.struct(F.lit("page-text").alias("id"), F.lit("paragraph").alias("type"), F.lit(0).alias("reading_order"), F.col("page.text").alias("text"), F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>").alias("bbox"))
    own = F.transform("page.blocks", lambda b: F.struct(*[b[f].alias(f) for f in ("id", "type", "reading_order", "text", "bbox")]))
    empty = F.coalesce(F.size("page.blocks"), F.lit(0)) <= 0
    chosen = F.when(~empty, own).when(F.col("page.text") != "", F.array(whole))
    keys = [c for c in ("document_id", "run_id", "parser_name", "parser_version") if c in docs.columns]
    rows = pages_of(docs, keys).select(*keys, "page_number", F.posexplode(chosen).alias("at", "b"))
    return rows.select(
        F.concat_ws(":", *[F.col(k) for k in keys[:2]], F.col("page_number").cast("string"), F.col("b.id")).alias("block_id"),
        *keys, "page_number", F.col("b.text").alias("text"), F.lit("canonical_parser").alias("source_kind"), F.col("b.id").alias("canonical_block_id"),
        F.col("b.type").alias("block_type"), F.col("b.reading_order").alias("reading_order"), F.col("b.bbox").alias("bbox"),
    )


def empty_pages(pages: DataFrame) -> DataFrame:
    """document_id and the sorted numbers of its pages without text."""
    return pages.filter(F.trim("text") == "").groupBy("document_id").agg(F.sort_array(F.collect_list("page_number")).alias("empty_pages"))


def assemble_text(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and full_text: page texts that aren't empty, joined by a blank line in order of page."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"))
