"""Results scored as they arrive, and scored again when ground truth arrives late or changes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgauge.operators.operations import latest
from docgauge.plans.evaluate import evaluate


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where none is set, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="docgauge-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def score_stream(results: DataFrame, truth: Callable[[], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Evaluates every micro-batch of canonical results (a stream) with the same plan as a batch and appends to path.

    A batch that runs again after a failure writes its own folder again, so no result is
    counted twice; read with current_scores().
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch, truth()).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return results.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def score_joined(results: DataFrame, truth: DataFrame, path: str, checkpoint: str, version: str = "version", **trigger) -> StreamingQuery:
    """Evaluates results and ground truth that both are streams, each run as soon as the later of the two is there.

    results: canonical documents with run_id, document_id and a version; truth: ground truth by
    document_id with a version.  Both sides are kept as state by document (give them watermarks
    on an event time to bound it), so ground truth may come before or after its results, and a
    new version of either scores its runs again.  Of a run that a batch holds several times the
    greatest pair of versions counts; read with current_scores(..., by versions).
    """
    gold = truth.select("document_id", F.col(version).alias("truth_version"), F.struct("full_text", "pages", "pii_entities").alias("gold"))
    pairs = results.withColumnRenamed(version, "run_version").join(gold, "document_id")

    def score(batch: DataFrame, batch_id: int) -> None:
        runs = latest(batch, ["run_id"], "run_version", "truth_version")
        # A ground truth of its own for each run, as runs of one document may have met different versions.
        mine = runs.select(F.col("run_id").alias("document_id"), "gold.full_text", "gold.pages", "gold.pii_entities")
        scored = evaluate(runs.withColumn("document_id", F.col("run_id")).drop("gold"), mine).drop("document_id")
        named = scored.join(runs.select("run_id", "document_id", "run_version", "truth_version").hint("merge"), "run_id")
        named.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pairs.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_scores(scores: DataFrame) -> DataFrame:
    """The last scores of every run: by versions where the scores have them, then by batch."""
    order = [c for c in ("run_version", "truth_version", "batch_id") if c in scores.columns]
    return latest(scores, ["run_id"], *order)


def rescored(predictions: DataFrame, truth: DataFrame, changed: DataFrame) -> DataFrame:
    """Scores of the runs whose document's ground truth changed (changed: document_id)."""
    runs = predictions.join(changed.select("document_id").distinct().hint("merge"), "document_id", "left_semi")
    return evaluate(runs, truth)
