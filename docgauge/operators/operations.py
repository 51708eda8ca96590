"""Views on runs and experiments: statuses, boards, histograms, last-write-wins tables, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def experiment_status(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """experiment_id, status, n_runs, n_succeeded, progress (percent of runs that ended)."""
    parse, deid = F.col("parse_status"), F.col("deidentification_status")
    done = parse == "SUCCEEDED"
    counts = runs.groupBy("experiment_id").agg(
        F.count("*").alias("n_runs"),
        F.count_if(parse == "PENDING").alias("pending"),
        F.count_if(parse.isin("PENDING", "RUNNING")).alias("open"),
        F.count_if(done).alias("n_succeeded"),
        F.count_if(done & deid.isin("PENDING", "RUNNING")).alias("deid_open"),
        F.count_if(done & deid.isin("FAILED", "INTERRUPTED")).alias("deid_failed"),
    )
    n = F.col("n_runs")
    status = (
        F.when((n == 0) | (F.col("pending") == n), "PENDING")
        .when(F.col("open") > 0, "RUNNING")
        .when(F.col("n_succeeded") == 0, "FAILED")
        .when(F.col("deid_open") > 0, "RUNNING")
        .when((F.col("n_succeeded") != n) | (F.col("deid_failed") > 0), "PARTIALLY_COMPLETED")
        .otherwise("COMPLETED")
    )
    whole = experiments.join(counts, "experiment_id", "left").na.fill(0)
    return whole.withColumns({"status": status, "progress": F.when(n > 0, 100 * (n - F.col("open")) / n).otherwise(0.0)}).drop("pending", "open", "deid_open", "deid_failed")


def board(runs: DataFrame) -> DataFrame:
    """One row: success rate in percent of ended runs, average latency, active and failed runs."""
    status = F.col("parse_status")
    ended = F.count_if(status.isin("SUCCEEDED", "FAILED"))
    return runs.agg(
        F.when(ended > 0, 100 * F.count_if(status == "SUCCEEDED") / ended).alias("success_rate"),
        F.avg("latency_ms").alias("average_latency_ms"),
        F.count_if(status.isin("PENDING", "RUNNING")).alias("active_runs"),
        F.count_if(status == "FAILED").alias("failed_runs"),
    )


def by_parser(runs: DataFrame, n: int | None = None) -> DataFrame:
    """parser_name, n_runs, average_latency_ms, most used first; the first n if given."""
    rows = runs.groupBy("parser_name").agg(F.count("*").alias("n_runs"), F.avg("latency_ms").alias("average_latency_ms")).orderBy(F.desc("n_runs"), "parser_name")
    return rows.limit(n) if n else rows


def daily_histogram(runs: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """day, n_runs for the days up to last_day, zero where nothing ran.  last_day: a literal or function, not a column of runs."""
    spark = runs.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), F.to_date(last_day))).alias("day"))
    counts = runs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_runs"))
    return calendar.join(counts.hint("merge"), "day", "left").na.fill(0, ["n_runs"])


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order: the table after last-write-wins upserts."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])))
    return ranked.filter("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with changes written over rows of the same key."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def exclusive_preference(manual: DataFrame) -> DataFrame:
    """Manual evaluations (with experiment_id) in which each evaluator prefers one run of an experiment: the newest that was marked."""
    window = Window.partitionBy("evaluator_id", "experiment_id").orderBy(F.desc("is_preferred"), F.desc("updated_at"), "run_id")
    return manual.withColumn("_n", F.row_number().over(window)).withColumn("is_preferred", F.col("is_preferred") & (F.col("_n") == 1)).drop("_n")


def retry_stage(parse: Column, deid: Column, has_input: Column) -> Column:
    """Which stage of a run a retry runs again, null for none."""
    return F.when(parse.isin("FAILED", "INTERRUPTED", "CANCELLED"), "parse").when((parse == "SUCCEEDED") & deid.isin("FAILED", "INTERRUPTED"), F.when(has_input, "deidentification").otherwise("parse"))


def display_status(parse: Column, deid: Column) -> Column:
    return F.when((parse == "SUCCEEDED") & deid.isin("PENDING", "RUNNING"), "RUNNING").when((parse == "SUCCEEDED") & (deid == "FAILED"), "PARTIALLY_COMPLETED").otherwise(parse)


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which a column contains text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return rows.filter(hit) if text else rows


def owned(rows: DataFrame, owner: str, column: str = "owner_id") -> DataFrame:
    """Rows of one owner, newest first."""
    return rows.filter(F.col(column) == owner).orderBy(F.desc("created_at"))


def with_documents(rows: DataFrame, documents: DataFrame, owner: str | None = None) -> DataFrame:
    """rows (by document_id) with document_filename; of one owner's documents only if an owner is given, newest first.

    documents: document_id, original_filename, owner_id.  Rows whose document is gone are left out.
    """
    mine = documents if owner is None else documents.filter(F.col("owner_id") == owner)
    named = rows.join(mine.select("document_id", F.col("original_filename").alias("document_filename")).hint("merge"), "document_id")
    return named.orderBy(F.desc_nulls_last("updated_at"), "document_id") if "updated_at" in rows.columns else named


def result_sizes(results: DataFrame) -> DataFrame:
    """run_id, result_size_bytes: each artifact path once."""
    files = results.select("run_id", F.explode("artifact_manifest").alias("f")).select("run_id", "f.path", "f.size_bytes").dropDuplicates(["run_id", "path"])
    return files.groupBy("run_id").agg(F.sum("size_bytes").alias("result_size_bytes"))


def token_usage(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and summed token counts; missing counts are 0."""
    return answers.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


def with_snapshots(runs: DataFrame, connectors: DataFrame) -> DataFrame:
    """Runs (parser_id) with parser_name, parser_version and adapter as their connector (parser_id, name, model_version, adapter) has them now."""
    now = connectors.select("parser_id", F.col("name").alias("parser_name"), F.col("model_version").alias("parser_version"), F.col("adapter").alias("parser_adapter"))
    return runs.join(now, "parser_id", "left")


def trace(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, stage_at, stage, row (JSON): the rows of all stages in their order, whatever their columns."""
    made = [df.select(*keys, F.lit(i).alias("stage_at"), F.lit(name).alias("stage"), F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("row")) for i, (name, df) in enumerate(stages.items())]
    whole = made[0]
    for rows in made[1:]:
        whole = whole.unionByName(rows)
    return whole
