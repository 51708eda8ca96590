"""Runs side by side and text differences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.functions.columns import csv_safe, normalize_space
from docgauge.functions.distances import kept
from docgauge.functions.frames import slices

#: A replaced stretch of at most so many characters is aligned by character as well.
FINE_CHARS = 400
#: Longer stretches of words are first parted at runs that stand once in each side; by size, not by the clock, so results don't depend on the machine.
WORDS = 25_000
UNITS = ("both", "words", "characters")
ANCHOR_RUNS = (4, 2, 1)
_TOKENS = re.compile(r"\S+\s*|\s+")

#: The columns of the CSV export.
CSV_COLUMNS = (
    "run_id", "parser_name", "parser_version", "parse_status", "deidentification_status", "latency_ms", "page_count", "text_length",
    "block_count", "table_count", "image_count", "result_size_bytes", "detected_entity_count", "masked_entity_count", "text_score",
    "table_score", "reading_order_score", "deidentification_score", "is_preferred", "notes",
)


def _opcodes(a, b) -> Iterator[tuple[str, int, int, int, int]]:
    """equal and replace stretches of a longest common subsequence (of words or characters)."""
    i = k = size = 0
    for x, y in kept(a, b):
        if (x, y) != (i + size, k + size):
            if size:
                yield "equal", i, i + size, k, k + size
            yield "replace", i + size, x, k + size, y
            i, k, size = x, y, 0
        size += 1
    if size:
        yield "equal", i, i + size, k, k + size
    if i + size < len(a) or k + size < len(b):
        yield "replace", i + size, len(a), k + size, len(b)


def _anchors(a: list[str], b: list[str], size: int) -> list[tuple[int, int]]:
    """Places of the runs of size units that stand once in each side, the longest series that rises in both."""

    def once(units: list[str]) -> dict:
        runs = list(zip(*(units[k:] for k in range(size)), strict=False))
        seen = Counter(runs)
        return {run: i for i, run in enumerate(runs) if seen[run] == 1}

    there = once(b)
    both = [(i, there[run]) for run, i in once(a).items() if run in there]
    ends, last, before = [], [], [-1] * len(both)
    for n, (_, j) in enumerate(both):
        at = bisect_left(ends, j)
        ends[at : at + 1], last[at : at + 1] = [j], [n]
        before[n] = last[at - 1] if at else -1
    series, n = [], last[-1] if last else -1
    while n >= 0:
        series.append(both[n])
        n = before[n]
    return series[::-1]


def _aligned(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """Opcodes between words.  More than WORDS of them are parted at runs that stand once in each side, and aligned in between."""
    work = [(0, len(a), 0, len(b), ANCHOR_RUNS)]
    while work:
        i, j, k, m, runs = work.pop()
        if i == j and k == m:
            continue
        if i == j or k == m:
            yield "replace", i, j, k, m
        elif j - i + m - k > WORDS and runs:
            found = [(i + x, k + y) for x, y in _anchors(a[i:j], b[k:m], runs[0])]
            if not found:
                work.append((i, j, k, m, runs[1:]))
                continue
            parts = []
            for x, y in found:
                # An anchor is a stretch of one equal unit.  In a stretch other runs stand once, so the longest are tried again.
                parts += [(i, x, k, y, ANCHOR_RUNS), (x, x + 1, y, y + 1, ())]
                i, k = x + 1, y + 1
            work += reversed([*parts, (i, j, k, m, ANCHOR_RUNS)])
        else:
            for kind, p, q, r, s in _opcodes(a[i:j], b[k:m]):
                yield kind, i + p, i + q, k + r, k + s


def diff_parts(base: str, target: str, unit: str = "both") -> list[tuple[str, str]]:
    """(equal, removed or added, text): equal and removed parts make up base, equal and added ones target.

    As many words (with the space behind them) as possible are equal; unit says whether small
    replaced stretches are aligned again by character (both), or whether all is compared by
    words or by characters.
    """
    parts: list[list[str]] = []

    def add(kind: str, text: str) -> None:
        if text:
            if parts and parts[-1][0] == kind:
                parts[-1][1] += text
            else:
                parts.append([kind, text])

    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    if unit == "characters":
        for kind, i, j, k, m in _opcodes(base, target):
            add("equal" if kind == "equal" else "removed", base[i:j])
            if kind != "equal":
                add("added", target[k:m])
        return [(kind, text) for kind, text in parts]
    a, b = _TOKENS.findall(base), _TOKENS.findall(target)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    add("equal", "".join(a[:head]))
    a_mid, b_mid = a[head : len(a) - tail], b[head : len(b) - tail]
    for kind, i, j, k, m in _aligned(a_mid, b_mid):
        old, new = "".join(a_mid[i:j]), "".join(b_mid[k:m])
        if kind == "equal":
            add("equal", old)
        elif unit == "both" and old and new and len(old) + len(new) <= FINE_CHARS:
            for fine, p, q, r, s in _opcodes(old, new):
                if fine == "equal":
                    add("equal", old[p:q])
                else:
                    add("removed", old[p:q])
                    add("added", new[r:s])
        else:
            add("removed", old)
            add("added", new)
    add("equal", "".join(a[len(a) - tail :]))
    return [(kind, text) for kind, text in parts]


def text_diffs(pairs: DataFrame, base: str = "base", target: str = "target", normalize: bool = True, unit: str = "both") -> DataFrame:
    """pairs with diff (array of type, text), similarity_ratio, added_count, removed_count.

    Null texts count as empty.  similarity_ratio is 2 * equal / (both lengths), 1 where both
    are empty, to four places.  Equal texts don't go through Python.
    """
    clean = lambda c: F.coalesce(normalize_space(F.col(c)) if normalize else F.col(c), F.lit(""))
    rows = pairs.withColumns({base: clean(base), target: clean(target)})

    @F.pandas_udf("array<struct<type: string, text: string>>")
    def diffed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            # Texts without much in common have a part for every few characters, so parts of a whole batch would be many times its size.
            for low, high in slices(a, b):
                yield pd.Series([[{"type": k, "text": t} for k, t in diff_parts(x, y, unit)] if x is not None else None for x, y in zip(a.iloc[low:high], b.iloc[low:high], strict=True)], dtype=object)

    same = F.col(base) == F.col(target)
    whole = F.when(F.col(base) == "", F.array().cast("array<struct<type: string, text: string>>")).otherwise(F.array(F.struct(F.lit("equal").alias("type"), F.col(base).alias("text"))))
    rows = rows.withColumn("diff", F.when(same, whole).otherwise(diffed(F.when(~same, F.col(base)), F.when(~same, F.col(target)))))
    return summarized(rows, base, target)


def summarized(rows: DataFrame, base: str = "base", target: str = "target") -> DataFrame:
    """Adds similarity_ratio, added_count, removed_count from diff."""
    size = lambda kind: F.aggregate(F.filter("diff", lambda p: p["type"] == kind), F.lit(0), lambda n, p: n + F.length(p["text"]))
    both = F.length(base) + F.length(target)
    return rows.withColumns(
        {"similarity_ratio": F.when(both == 0, 1.0).otherwise(F.round(2 * size("equal") / both, 4)), "added_count": size("added").cast("long"), "removed_count": size("removed").cast("long")}
    )


def run_pairs(texts: DataFrame, base_run: str | None = None) -> DataFrame:
    """Pairs of runs of one experiment (experiment_id, run_id, text): all pairs by run_id, or base_run with every other."""
    a = texts.select("experiment_id", F.col("run_id").alias("base_run"), F.col("text").alias("base"))
    b = texts.select("experiment_id", F.col("run_id").alias("target_run"), F.col("text").alias("target"))
    both = a.join(b.hint("merge"), "experiment_id")
    return both.filter(F.col("base_run") < F.col("target_run")) if base_run is None else both.filter((F.col("base_run") == base_run) & (F.col("target_run") != base_run))


def comparison(runs: DataFrame, results: DataFrame, deidentified: DataFrame, manual: DataFrame, evaluator: str) -> DataFrame:
    """One row per run with its result counts, sizes, de-identification counts and one evaluator's scores; nulls where there is none."""
    from docgauge.operators.operations import result_sizes

    mine = manual.filter(F.col("evaluator_id") == evaluator).drop("evaluator_id", "updated_at")
    rows = runs.join(results.drop("artifact_manifest").hint("merge"), "run_id", "left").join(result_sizes(results).hint("merge"), "run_id", "left")
    rows = rows.join(deidentified.select("run_id", "detected_entity_count", "masked_entity_count").hint("merge"), "run_id", "left").join(mine.hint("merge"), "run_id", "left")
    return rows.na.fill({"is_preferred": False, "result_size_bytes": 0})


def csv_rows(compared: DataFrame) -> DataFrame:
    """The columns of the CSV export, safe for spreadsheets; a byte order mark leads the first name."""
    guarded = ("parser_name", "parser_version", "notes")
    names = {CSV_COLUMNS[0]: "﻿" + CSV_COLUMNS[0]}
    return compared.select(*[(csv_safe(F.col(c)) if c in guarded else F.col(c)).alias(names.get(c, c)) for c in CSV_COLUMNS])
