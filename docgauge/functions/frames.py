"""Helpers over whole tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Characters of the texts that a slice of a batch holds, about.
SLICE = 250_000
#: Names the folder of everything that this process cuts.
RUN = f"docgauge-tables-{uuid.uuid4().hex}"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task sorts or keeps in a table of hashes, about.
TASK_ROWS = 500_000


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder for checkpoints that the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder and folder.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """rows written once where the session names a folder for checkpoints, so that what builds on them doesn't compute them again; streams stay as they are.

    They are written as Parquet, and the shuffle files of this step go as soon as they are.
    """
    spark = rows.sparkSession
    folder = checkpoint_folder(spark)
    if rows.isStreaming or not folder:
        return rows
    if "void" in rows.schema.simpleString():  # Parquet has no such type
        return rows.checkpoint()
    path = f"{folder}/{RUN}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = spark.read.schema(rows.schema).parquet(path)
    made.stored_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes what cut() has written of tables that nothing will read again: all that was made of them is cut as well.  Others stay as they are."""
    for table in tables:
        if getattr(table, "stored_at", None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(*texts: pd.Series, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Begins and ends of slices of a batch whose texts (null: none) have about limit characters; so what a function makes of a batch is handed on in parts."""
    low, held = 0, 0
    for at, row in enumerate(zip(*texts, strict=True)):
        held += sum(len(t) for t in row if t is not None)
        if held >= limit:
            yield low, at + 1
            low, held = at + 1, 0
    if low < len(texts[0]):
        yield low, len(texts[0])


def tasks_for(rows: DataFrame) -> int:
    """Tasks for work that sorts or hashes rows, so that a task's share doesn't grow with the table (Spark goes by compressed bytes, which say little of short keys)."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to so many tasks; as they are without a number."""
    return rows.repartition(tasks, *keys) if tasks else rows
