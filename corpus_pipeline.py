"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.decontam import clean_documents
from docgauge.llm.lines import without_repeated_lines
from docgauge.llm.near import one_of_each
from docgauge.llm.packing import pack
from docgauge.llm.quality import good_documents
from docgauge.llm.queries import vocabulary
from docgauge.llm.stage import free_name, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality model keeps.

    Null and empty texts go, very long ones are counted whole; a posterior of just 0.5 is kept;
    rows that repeat share their verdict; an empty table stays empty; columns of any name stay.
    """
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document of smaller doc_id holds; n_chars follows.

    Null texts become empty, empty ones stay; very long ones are taken whole.  Null doc_ids
    count as one document before all others, rows that share a doc_id as one document too; an
    empty table stays empty; columns of any name stay.
    """
    apart = {c: free_name(docs.columns, f"_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "keep")}
    kept = without_repeated_lines(docs.withColumnsRenamed(apart)).drop("n_lines", "n_dropped", "keep").withColumnsRenamed({v: k for k, v in apart.items()}).select(*[f"`{c}`" for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of least doc_id: 5-word shingles, Jaccard similarity 0.8 or more.

    Null and empty texts are copies of each other; null doc_ids come first; of rows that
    repeat one stays; very long texts are compared whole; an empty table stays empty; columns
    of any name stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark.

    Null and empty texts stay, very long ones are scanned whole; rows that repeat share their
    verdict; an empty table on either side changes nothing; columns of any name stay.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048.

    A null or empty text is the single end token, a very long one several pieces; null doc_ids
    stay null; rows that repeat are packed as often; an empty table gives no rows; other
    columns are ignored.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Tokens, similarities and fitted accuracies are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
