"""Personal data found and masked by ordered lists of (type, pattern)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Built-in patterns in their order.
RULES: tuple[tuple[str, str], ...] = (
    ("RRN", r"(?<!\d)\d{6}-?[1-4]\d{6}(?!\d)"),
    ("EMAIL", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])"),
    ("PHONE", r"(?<!\d)(?:01[016789]|0(?:2|[3-6][1-5]))[- ]?\d{3,4}[- ]?\d{4}(?!\d)"),
)
MASKERS: dict[str, tuple[tuple[str, str], ...]] = {"builtin": RULES}


def register_masker(name: str, rules: tuple[tuple[str, str], ...]) -> None:
    """Makes a list of rules known by name."""
    for _, pattern in rules:
        re.compile(pattern)
    MASKERS[name] = tuple(rules)


def masked(text: Column, masker: str = "builtin") -> Column:
    """text with every match replaced by [TYPE], rule after rule; native."""
    for kind, pattern in MASKERS[masker]:
        text = F.regexp_replace(text, f"(?U){pattern}", f"[{kind}]")
    return text


def match_counts(text: Column, masker: str = "builtin") -> Column:
    """Matches by type, each rule on what the ones before it left; native."""
    counts = []
    for kind, pattern in MASKERS[masker]:
        counts += [F.lit(kind), F.size(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)))]
        text = F.regexp_replace(text, f"(?U){pattern}", f"[{kind}]")
    return F.create_map(*counts)


def entity_spans(text: Column, masker: str = "builtin", offsets: str = "original") -> Column:
    """Array of type, start, end.

    offsets: "original" gives places in the input, "progressive" places in the text that the
    rules before have already masked.
    """
    rules = [(kind, re.compile(pattern)) for kind, pattern in MASKERS[masker]]

    def found(value: str | None) -> list[dict]:
        spans, current, moves = [], value or "", []
        for kind, pattern in rules:
            here = list(pattern.finditer(current))
            for m in here:
                start, end = m.span()
                if offsets == "original":
                    # A masked part that lies before moves what follows it by its change of length.
                    shift = 0
                    for at, grown in moves:
                        shift += grown if at + grown <= start - shift + grown and at <= start - shift else 0
                    start, end = start - shift, end - shift
                spans.append({"type": kind, "start": start, "end": end})
            if offsets == "original":
                moves = sorted(moves + [(s["start"], len(kind) + 2 - (s["end"] - s["start"])) for s in spans[len(spans) - len(here) :]])
            current = pattern.sub(f"[{kind}]", current)
        return spans

    @F.pandas_udf("array<struct<type: string, start: int, `end`: int>>")
    def spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([found(t) for t in batch], dtype=object)

    return spans_of(text)


def deidentify(inputs: DataFrame, masker: str = "builtin") -> DataFrame:
    """inputs (run_id, text) with entities, deidentified_text, counts and lengths; the entities hold no text."""
    rows = inputs.withColumns({"entities": entity_spans(F.col("text"), masker), "deidentified_text": masked(F.col("text"), masker)})
    n = F.size("entities")
    return rows.withColumns({"detected_entity_count": n, "masked_entity_count": n, "input_characters": F.length("text"), "output_characters": F.length("deidentified_text")})


def masking_input(input_type: Column) -> Column:
    """The text that a de-identification run reads (columns original, text, markdown, full_text), null where it is missing or empty."""
    chosen = F.when(input_type == "ORIGINAL", F.col("original")).when(input_type == "TEXT", F.col("text")).when(input_type == "MARKDOWN", F.col("markdown")).when(input_type == "CANONICAL_JSON", F.col("full_text"))
    return F.when(F.trim(chosen) != "", chosen)


#: Names of counts, lists and texts in vendors' results; texts in order of preference.
DETECTED = ("detected_entity_count", "detectedEntityCount", "detectedCount", "detectCount", "totalCount")
MASKED = ("masked_entity_count", "maskedEntityCount", "maskedCount", "maskingCount")
FOUND_LISTS = ("detections", "entities", "items")
MASKED_TEXTS = ("deidentified_text", "deidentifiedText", "masked_text", "maskedText", "output", "text", "content")


def _objects_of(tree) -> Iterator[dict]:
    """All objects of a JSON value, each before those inside it."""
    work = [tree]
    while work:
        node = work.pop()
        if isinstance(node, dict):
            yield node
            work += reversed(list(node.values()))
        elif isinstance(node, list):
            work += reversed(node)


def vendor_summary(raw: Column) -> Column:
    """detected, masked, text of a vendor's JSON result, wherever they stand in it; masked defaults to detected, text to an empty one.

    What is no JSON object or list gives null.
    """
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)

    def one(text: str | None) -> dict | None:
        try:
            tree = json.loads(text) if text else None
        except ValueError:
            return None
        if not isinstance(tree, dict | list):
            return None
        objects = list(_objects_of(tree))
        count = lambda names: next((int(x) for o in objects for k, x in o.items() if k in names and number(x)), None)
        detected = count(DETECTED)
        if detected is None:
            detected = next((len(x) for o in objects for k, x in o.items() if k in FOUND_LISTS and isinstance(x, list)), None)
        masked_ = count(MASKED)
        shown = next((o[k] for o in objects for k in MASKED_TEXTS if isinstance(o.get(k), str)), "")
        return {"detected": detected, "masked": detected if masked_ is None else masked_, "text": shown}

    @F.pandas_udf("detected int, masked int, text string")
    def summary(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) or {"detected": None, "masked": None, "text": None} for t in texts]
        return pd.DataFrame({"detected": pd.array([r["detected"] for r in rows], "Int32"), "masked": pd.array([r["masked"] for r in rows], "Int32"), "text": [r["text"] for r in rows]})

    return summary(raw)
