"""Differences of long texts."""

import random
import time

import pytest

from docgauge.operators import compare


def numbered(n_words: int) -> tuple[str, str]:
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.6)) % 4000}" for _ in range(n_words)]
    lines = [" ".join(words[i : i + 10]) for i in range(0, n_words, 10)]
    return " ".join(lines), " ".join(f"{i:03d} | {x}" for i, x in enumerate(lines, 1))


def ratio(base: str, target: str) -> float:
    parts = compare.diff_parts(base, target)
    assert "".join(t for k, t in parts if k != "added") == base and "".join(t for k, t in parts if k != "removed") == target
    return 2 * sum(len(t) for k, t in parts if k == "equal") / (len(base) + len(target))


@pytest.mark.parametrize("n_words", [9_000, 14_000, 40_000])
def test_numbered_lines_are_near_at_any_size(n_words):
    base, target = numbered(n_words)
    began = time.time()
    found = ratio(base, target)
    assert found > 0.95 * 2 * len(base) / (len(base) + len(target)), (found, time.time() - began)


def test_long_texts_without_common_words():
    assert ratio(" ".join(f"a{i}" for i in range(15_000)), " ".join(f"b{i}" for i in range(15_000))) < 0.05


def _timed(base: str, target: str) -> tuple[float, float]:
    began = time.time()
    return ratio(base, target), time.time() - began


def test_bounds_of_repetitive_texts(spark):
    """Identical texts don't reach Python; repetitive lines against their numbered copy; lines with rare anchors."""
    same = "the same phrase again " * 10_000
    pair = spark.createDataFrame([(same, same)], "base string, target string")
    assert compare.text_diffs(pair).select("similarity_ratio", "added_count", "removed_count").first() == (1.0, 0, 0)
    for lines in (["a line that repeats"] * 5000, [f"Paragraph {i % 200}: parties keep documents and personal data safe. mail{i % 500}@example.org" for i in range(5000)]):
        found, seconds = _timed(" ".join(lines), " ".join(f"{i:03d} | {x}" for i, x in enumerate(lines, 1)))
        assert found > 0.7 and seconds < 2.5
    lines = [f"own-clause-{i} parties keep documents and personal data safe." for i in range(800)]
    found, seconds = _timed(" ".join(lines), " ".join(f"{i:03d} | {x}" for i, x in enumerate(lines, 1)))
    assert found > 0.5 and seconds < 1.0


@pytest.mark.parametrize("unit", compare.UNITS)
def test_units(unit):
    base, target = "one two three four", "one too three  for"
    parts = compare.diff_parts(base, target, unit)
    assert "".join(t for k, t in parts if k != "added") == base and "".join(t for k, t in parts if k != "removed") == target
    equal = [t for k, t in parts if k == "equal"]
    assert equal == {"words": ["one "], "both": ["one t", "o", " three ", "fo", "r"], "characters": ["one t", "o", " three ", "fo", "r"]}[unit]
    with pytest.raises(ValueError, match="unit"):
        compare.diff_parts("a", "b", "lines")
