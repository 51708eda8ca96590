"""Evaluations of many runs summed up per parser, version and configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.columns import config_hash, finite, t_critical

GROUP = ["parser_name", "parser_version", "config_hash"]


def evaluations(runs: DataFrame, truth: DataFrame, results: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of succeeded runs with their run, dataset and result columns and config_hash."""
    done = runs.filter("parse_status = 'SUCCEEDED'").withColumn("config_hash", config_hash(F.col("config")))
    return scores.join(done.hint("merge"), "run_id").join(truth.select("document_id", "dataset_name", "dataset_version").hint("merge"), "document_id").join(results.select("run_id", "page_count").hint("merge"), "run_id")


def metric_intervals(evaluated: DataFrame, metrics: list[str], unbounded: tuple[str, ...] = ("text_cer",), keys: list[str] = GROUP) -> DataFrame:
    """keys, metric, n, mean, ci_low, ci_high: Student's 95 % interval, within 0 and 1 (unbounded ones: from 0).

    Values that are null or not finite are left out; one value has a mean but no interval.
    """
    long = evaluated.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("value")) for m in metrics])).alias("m")).select(*keys, "m.*")
    grouped = long.filter("value is not null").groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    half = F.when(F.col("n") > 1, t_critical(F.col("n")) * F.col("deviation") / F.sqrt("n"))
    high = F.col("mean") + half
    low = F.greatest(F.lit(0.0), F.col("mean") - half)
    capped = F.when(F.col("metric").isin(*unbounded), high).otherwise(F.least(F.lit(1.0), high))
    return grouped.select(*keys, "metric", "n", "mean", F.when(half.isNotNull(), low).alias("ci_low"), F.when(half.isNotNull(), capped).alias("ci_high"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and exact percentiles (interpolated) of value by name; nulls don't count, groups without values are left out.

    Equal values are counted first, and counts are summed up in order of value, so that a group
    of any size costs its different values and no row holds them.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy(value)), "_all": F.sum("_n").over(group)})
    place = lambda q: q * (F.col("_all") - 1)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    ends = [x for name, q in shares.items() for x in (at(F.floor(place(q))).alias(f"{name}_low"), at(F.ceil(place(q))).alias(f"{name}_high"))]
    found = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *ends)
    between = lambda name, q: F.col(f"{name}_low") + (place(q) - F.floor(place(q))) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return found.select(*keys, *[between(name, q).cast("double").alias(name) for name, q in shares.items()])


def operations(evaluated: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Runs, documents, latency percentiles (interpolated), pages a minute and dataset versions of each group."""
    timed = F.col("latency_ms") > 0
    known = [F.col(c).alias(f"_{c}") for c in keys]
    latency = percentiles(evaluated, keys, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}).select(*known, "latency_p50", "latency_p95")
    summed = evaluated.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.count_distinct("document_id").alias("n_documents"),
        (F.sum(F.when(timed, F.col("page_count"))) / (F.sum(F.when(timed, F.col("latency_ms"))) / 60000)).alias("pages_per_minute"),
        F.array_sort(F.collect_set(F.concat_ws("@", "dataset_name", "dataset_version"))).alias("dataset_versions"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    joined = summed.join(latency.hint("shuffle_hash"), same, "left")
    return joined.select(*keys, "n_runs", "n_documents", "latency_p50", "latency_p95", "pages_per_minute", "dataset_versions")


def leaderboard(groups: DataFrame, value: str = "overall_quality", tie: list[str] = GROUP) -> DataFrame:
    """Groups with their rank; 0 and null tie at the end."""
    order = Window.orderBy(F.coalesce(F.nullif(F.col(value), F.lit(0.0)), F.lit(-1.0)).desc(), *tie)
    return groups.withColumn("rank", F.row_number().over(order))


def recent(evaluated: DataFrame, n: int = 50) -> DataFrame:
    """The latest evaluations."""
    return evaluated.orderBy(F.desc("created_at"), "run_id").limit(n)


def recompute_report(runs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluated and skipped succeeded runs of each group."""
    done = runs.filter("parse_status = 'SUCCEEDED'").join(scores.select("run_id", F.lit(True).alias("scored")).hint("merge"), "run_id", "left")
    return done.groupBy(*keys).agg(F.count("scored").alias("evaluated"), F.count_if(F.col("scored").isNull()).alias("skipped"))


def totals(truth: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: ground truth documents and evaluated runs."""
    sizes = truth.select(F.lit("ground_truth").alias("kind")).union(scores.select(F.lit("evaluated").alias("kind")))
    return sizes.agg(F.count_if(F.col("kind") == "ground_truth").alias("ground_truth_documents"), F.count_if(F.col("kind") == "evaluated").alias("evaluated_runs"))
