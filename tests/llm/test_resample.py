"""Resampling against a plain computation of buckets, gains, weights and draws."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgauge.llm import resample
from docgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def features(text, run=1):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, run=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, run)[1]) for texts in ([d[1] for d in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        words, found = features(text, run)
        weight = sum(gain[bucket(f)] for f in found) // max(len(found), 1)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted(tuple(map(str, r[:5])) for r in rows)


def made(df):
    return sorted(tuple(str(r[c]) for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def test_query_equals_brute_force(spark, some_documents):
    docs = [(r["doc_id"], r["text"]) for r in some_documents.collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert made(QUERIES["op12_importance_resampling"](spark, SF)) == brute(docs, target)


def test_odd_rows_runs_and_draws(spark, odd, clashing, odd_rows, empty):
    docs, target = [(r[0], r[1]) for r in odd_rows], ["One shared line", None, "by several documents", "é漢"]
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    for options in ({}, {"run": 3, "buckets": 97, "percent": 60, "least_words": 1}, {"percent": 100, "least_words": 0, "seed": 1}, {"percent": 0}):
        expected = brute(docs, target, **{{"least_words": "least"}.get(k, k): v for k, v in options.items()})
        assert made(resample.resampled(odd, aims, **options)) == expected
        assert made(resample.resampled(clashing, aims, **options)) == expected
    assert resample.resampled(empty, aims).collect() == []
    assert made(resample.resampled(odd, aims.limit(0))) == brute(docs, [])


def test_rows_that_repeat_share_ranks_out(spark):
    """One row of which most copies are drawn: ranks are all different, and no range holds all copies in the end."""
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = resample.resampled(df, df.limit(1), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, 151)) and len(rows) == 300


@pytest.mark.parametrize("run", [1, 2, 4])
def test_stretches_lose_nothing(run, monkeypatch):
    draw = random.Random(run)
    text = "".join(draw.choice(["a", "B", "é", "漢字", " ", "  ", "\n", "-", "9", "xyz "]) for _ in range(4000))
    words, found = features(text, run)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(resample, "_STRETCH", size)
        n, counts = resample.bucket_counts(text, run, 5003)
        assert n == len(words) and counts == Counter(zlib.crc32(f.encode()) % 5003 for f in found)
