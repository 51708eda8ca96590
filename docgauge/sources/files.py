"""Readers and writers: canonical documents, ground truth, catalogs, questions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.schemas import CANONICAL

MAX_TRUTH_BYTES = 25 * 2**20
BOM = "﻿"
#: Extensions that the catalog takes, with their media types.
MEDIA_TYPES = {
    "pdf": ("application/pdf",), "png": ("image/png",), "jpg": ("image/jpeg",), "jpeg": ("image/jpeg",), "tif": ("image/tiff",), "tiff": ("image/tiff",),
    "txt": ("text/plain",), "md": ("text/markdown", "text/plain"), "html": ("text/html",),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
}


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents, one JSON file each; what isn't a JSON object has nulls and its text in _corrupt_record."""
    return spark.read.schema(f"{CANONICAL}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_ground_truth(spark: SparkSession, path: str, max_bytes: int = MAX_TRUTH_BYTES) -> DataFrame:
    """path, payload (JSON text without byte order mark) and rule (null: usable) of every file."""
    files = spark.read.format("binaryFile").load(path)
    payload = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string"), f"^{BOM}", "")
    rule = F.when(F.col("length") > max_bytes, "too_large").when(payload.isNull(), "not_utf8").when(F.try_parse_json(payload).isNull(), "not_json")
    return files.select("path", F.when(F.col("length") <= max_bytes, payload).alias("payload"), rule.alias("rule"))


def catalog(files: DataFrame, max_bytes: int, declared: Column | None = None) -> DataFrame:
    """path, name, extension, size_bytes, sha256, rule (null: accepted) of binaryFile rows; declared: media type told by the sender."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    known = F.create_map(*[x for ext, types in MEDIA_TYPES.items() for x in (F.lit(ext), F.array(*map(F.lit, types)))])
    types = F.element_at(known, extension)
    rule = F.when(extension.isNull() | types.isNull(), "extension_not_supported").when(F.col("length") <= 0, "empty").when(F.col("length") > max_bytes, "too_large")
    if declared is not None:
        rule = rule.when(declared.isNotNull() & (declared != "application/octet-stream") & ~F.array_contains(types, declared), "media_type_differs")
    return files.select("path", name.alias("name"), extension.alias("extension"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), rule.alias("rule"))


#: The kinds of output that are read, and files beside them that are none.
OUTPUTS = ("json", "md", "txt")
NO_OUTPUTS = ("config.json",)


def first_outputs(files: DataFrame, root: str | None = None) -> DataFrame:
    """run, extension, path, text: the first readable json, md and txt file of each run in order of path (binaryFile rows).

    A run is the folder of its files or, with a root, the folder right below it, whatever
    lies deeper.  Configurations are no outputs.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    run = F.get(parts, F.size(parts) - 2) if root is None else F.get(F.split(F.substring_index("path", f"{root.rstrip('/')}/", -1), "/"), F.lit(0))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    rows = files.filter(~name.isin(*NO_OUTPUTS)).select("path", run.alias("run"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"), text.alias("text"))
    usable = rows.filter(F.col("extension").isin(*OUTPUTS) & F.col("text").isNotNull()).filter((F.col("extension") != "json") | F.try_parse_json("text").isNotNull())
    return usable.groupBy("run", "extension").agg(F.min("path").alias("path"), F.min_by("text", "path").alias("text"))


def command_text(text: Column, markdown: Column, stdout: Column) -> Column:
    """Text of a command's output: its text, else markdown, else what it printed."""
    return F.coalesce(text, markdown, F.nullif(F.trim(stdout), F.lit("")))


def raw_stub(raw: Column, stdout: Column, stderr: Column, most: int = 20_000) -> Column:
    """The raw result (JSON text), or one made of the first characters that the command printed."""
    return F.coalesce(raw, F.to_json(F.struct(F.left(stdout, F.lit(most)).alias("stdout"), F.left(stderr, F.lit(most)).alias("stderr"))))


def result_pages(files: DataFrame, keys: list[str], name: str = "name", text: str = "text") -> DataFrame:
    """keys, page_number, page (JSON text) over several JSON result files of a run, in order of name; unreadable files are skipped."""
    from pyspark.sql import Window

    v = F.try_parse_json(F.col(text))
    inner = F.coalesce(F.try_variant_get(v, "$.result", "variant"), v)
    pages = F.coalesce(F.try_variant_get(inner, "$.pages", "array<variant>"), F.try_variant_get(inner, "$", "array<variant>"), F.when(inner.isNotNull(), F.array(inner)))
    rows = files.select(*keys, name, F.posexplode(F.transform(pages, lambda x: F.to_json(x))).alias("at", "page"))
    return rows.withColumn("page_number", F.row_number().over(Window.partitionBy(*keys).orderBy(name, "at"))).select(*keys, "page_number", "page")


def artifacts(results: DataFrame) -> DataFrame:
    """A row for each artifact of a run's manifest."""
    return results.select("run_id", F.explode("artifact_manifest").alias("a")).select("run_id", "a.*")


def write_results(results: DataFrame, path: str, by: str = "dataset_version") -> None:
    """Results as Parquet, a folder for each dataset version; a few rows a file, not a file a run."""
    results.write.mode("append").partitionBy(by).parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header (see compare.csv_rows for the export's columns)."""
    rows.write.option("header", True).csv(path)


def prepare_questions(raw: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions without answers, gold rows, and violations.

    raw: question_id, doc_name, question, answer, evidence (array of doc_name, evidence_page_num
    from 0, evidence_text).  pages: document_id, page_number from 1.
    """
    counts = pages.groupBy(F.col("document_id").alias("doc_name")).agg(F.max("page_number").alias("n_pages"))
    rows = raw.join(counts.hint("merge"), "doc_name", "left")
    place = lambda e: F.struct(
        F.concat(F.col("doc_name"), F.lit(":p"), (e["evidence_page_num"] + 1).cast("string")).alias("block_id"), (e["evidence_page_num"] + 1).alias("page_number"), e["evidence_text"].alias("evidence_text")
    )
    questions = rows.select("question_id", F.col("doc_name").alias("document_id"), "question")
    gold = rows.select("question_id", F.col("answer").alias("reference_answer"), F.transform("evidence", place).alias("evidence"))
    outside = F.exists("evidence", lambda e: F.coalesce((e["evidence_page_num"] < 0) | (e["evidence_page_num"] >= F.col("n_pages")), F.lit(True)))
    broken = rows.filter(outside).select("question_id", F.lit("evidence_page_outside_document").alias("rule"), F.col("doc_name").alias("detail"))
    return questions, gold, broken
