"""Tables that several jobs of one operator share.

A job's intermediate rows are written as Parquet under ``spark.checkpoint.dir`` and
read back.  Lineage ends there, so a lost executor costs at most the running stage,
and Spark knows the true size of what it reads.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names the folder of everything that this process stores.
RUN = f"docgauge-{uuid.uuid4().hex}"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null doc_id inside the operators; no document may use it.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docgauge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of this run that isn't there yet."""
    return f"{shared_folder(spark)}/{RUN}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back; the shuffle files of this step go as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing will read again: all that was made of them has been stored."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, run: str | None = None) -> None:
    """Deletes what a run (by default this process) has stored; call it when its results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{run or RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_key() -> Column:
    """doc_id as a key that is never null; nulls come first and count as one document."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def id_from(key: str = "_key") -> Column:
    """The inverse of doc_key()."""
    return F.when(F.col(key) != NO_ID, F.col(key)).alias("doc_id")


def whole_text() -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col("text"), F.lit(""))


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
