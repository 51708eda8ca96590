"""Column functions: text, numbers, boxes, ids.  All native but normalize_text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two-sided 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T_CRITICAL = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
TOKEN = "[0-9A-Za-z]+|[가-힣]+"


@F.pandas_udf(T.StringType())
def normalize_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, all white space runs as one space, trimmed; null gives an empty text (SQL has no NFKC)."""
    for batch in texts:
        yield batch.map(lambda t: "" if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what stands in a lambda or a filter isn't shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_space(text: Column) -> Column:
    """All Unicode white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters: near texts and short ones by Spark, the rest bit-parallel."""
    from docgauge.functions.distances import counted, levenshtein

    n = lambda c: F.length(c)
    short = n(a).cast("long") * n(b) <= 4096
    far = ~short & (F.levenshtein(a, b, 16) == -1)
    by_bits = counted(levenshtein)(F.when(far, a), F.when(far, b)).cast("int")
    return F.when(a == b, 0).when(short, F.levenshtein(a, b)).otherwise(F.coalesce(F.nullif(F.levenshtein(a, b, 16), F.lit(-1)), by_bits))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole != 0, part / whole)


def f1_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1: F1 is 0 if anything was counted but either is undefined or both are 0, else null."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    defined = precision.isNotNull() & recall.isNotNull() & (precision + recall > 0)
    return precision, recall, F.when(defined, 2 * precision * recall / (precision + recall)).when(tp + fp + fn > 0, 0.0)


def count_accuracy(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b), null where both are 0."""
    return F.when(F.greatest(a, b) > 0, 1 - F.abs(a - b) / F.greatest(a, b))


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the values that aren't null; null without any."""
    known = F.filter(F.array(*[v.cast("double") for v in values]), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))


def tidy(metric: Column) -> Column:
    """Rounded to six places; what isn't finite stays."""
    return F.when(F.isnan(metric) | F.abs(metric).isin(float("inf")), metric).otherwise(F.round(metric, 6))


def finite(number: Column) -> Column:
    """The number, null where it is not finite."""
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def t_critical(n: Column) -> Column:
    """Student's t for a 95 % interval of n values; 1.96 beyond 31."""
    return F.when(n <= 31, F.get(F.array(*map(F.lit, T_CRITICAL)), (n - 2).cast("int"))).otherwise(1.96)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A bounding box, null where it is inverted or incomplete."""
    values = [c.try_cast("double") for c in (x1, y1, x2, y2)]
    valid = (values[2] >= values[0]) & (values[3] >= values[1])
    return F.when(valid, F.struct(*[v.alias(n) for v, n in zip(values, ("x1", "y1", "x2", "y2"), strict=True)]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    shared = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - shared
    return F.when(union != 0, shared / union).otherwise(0.0)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet doesn't take for a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case Latin and Hangul tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def stable_id(*parts: Column) -> Column:
    """SHA-256 over the parts; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])), 256)


def config_hash(config: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a JSON text in sorted compact form."""
    return F.substring(F.sha2(F.to_json(F.parse_json(F.coalesce(config, F.lit("{}")))), 256), 1, 12)


def first_filled(*texts: Column) -> Column:
    """The first text that isn't blank, trimmed; empty without any."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts], F.lit(""))


def printable(text: Column) -> Column:
    """Without control characters but line breaks, at most two of which follow each other; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cntrl}&&[^\n]]", ""), r"\n{3,}", "\n\n"))
