"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgauge.llm import decontam, lines, lmscore, packing, pii, quality, secret_scan, simhash, substrings, tokens

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "pack": lambda d: packing.pack(d, WORD),
    "repeats": substrings.without_repeats,
    "quality": quality.quality,
    "tokens": lambda d: tokens.token_counts(d, PIECE),
    "simhash": simhash.near_duplicates,
    "pii": lambda d: pii.with_surrogates(d, b"key"),
    "secrets": secret_scan.find_secrets,
    "lines": lines.without_repeated_lines,
    "decontam": lambda d: decontam.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "lmscore": lmscore.backoff_scores,
}
KEEPS_COLUMNS = {"repeats", "lines", "pii"}
ONE_ROW_EACH = set(OPERATORS) - {"pack", "decontam"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, clashing, odd_rows):
    rows = OPERATORS[name](odd).collect()
    made = OPERATORS[name](clashing)
    plain = lambda row, names: [str(row[c]) for c in names if c not in ("p_good", "log_score", "mean_log_score", "sequence_id", "offset")]
    again = made.collect()
    own = rows[0].__fields__
    assert sorted(plain(r, own) for r in rows) == sorted(plain(r, own) for r in again)
    if name in KEEPS_COLUMNS:  # what an operator doesn't return itself is still what it was
        clash = [c for c in clashing.columns if c not in own]
        assert len(clash) > 20 and set(clash) <= set(made.columns) and all(r[c] == "clash" for r in again for c in clash)
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stage_keeps_columns(stage, spark, odd, clashing, empty):
    sf_dir = "/root/testdata/sf0.001"
    assert stage(spark, empty, sf_dir).collect() == []
    if stage is corpus_pipeline.packing:
        assert {r["doc_id"] for r in stage(spark, odd, sf_dir).collect()} == {None, *range(1, 10)}
        return
    rows = stage(spark, odd, sf_dir)
    assert rows.columns == odd.columns and rows.count() <= odd.count()
    again = stage(spark, clashing, sf_dir)
    assert again.columns == clashing.columns
    found = again.collect()
    assert len(found) == rows.count() and all(r[c] == "clash" for r in found for c in clashing.columns[5:])  # the columns behind those of documents


def _planted_votes():
    import random

    draw = random.Random(1)
    share, on_good, on_bad = 0.8, [0.01, 0.05, 0.2, 0.02], [0.7, 0.6, 0.5, 0.4]
    counts = {}
    for _ in range(20_000):
        good = draw.random() < share
        votes = tuple(0 if draw.random() < 0.1 else -1 if draw.random() < p else 1 for p in (on_good if good else on_bad))
        counts[votes] = counts.get(votes, 0) + 1
    return counts, share, on_good, on_bad


def test_em_equals_brute_force_and_planted_rates(spark):
    """Expectation-maximisation as in plain Python, near the planted rates; a lone bad vote of a poor rule doesn't sink a document."""
    from math import exp, log

    from docgauge.llm.quality import BELIEFS, fit

    counts, share, on_good, on_bad = _planted_votes()
    names = ["a", "b", "c", "d"]
    patterns = spark.createDataFrame([(*k, n) for k, n in counts.items()], [*names, "n"])
    found = fit(patterns, names)
    rate = lambda x, n, belief: (x + belief[0]) / (n + sum(belief))
    s, p, q = 0.7, dict.fromkeys(names, 0.02), dict.fromkeys(names, 0.3)
    for _ in range(200):
        good = {}
        for votes, n in counts.items():
            odds = log(s / (1 - s)) + sum(log((p[v] if x < 0 else 1 - p[v]) / (q[v] if x < 0 else 1 - q[v])) for v, x in zip(names, votes) if x)
            good[votes] = n / (1 + exp(-odds))
        total = lambda v, w, bad: sum(w[k] for k in counts if k[names.index(v)] and (not bad or k[names.index(v)] < 0))
        rest = {k: counts[k] - good[k] for k in counts}
        s = rate(sum(good.values()), sum(counts.values()), BELIEFS["share"])
        p = {v: rate(total(v, good, True), total(v, good, False), BELIEFS["on_good"]) for v in names}
        q = {v: rate(total(v, rest, True), total(v, rest, False), BELIEFS["on_bad"]) for v in names}
    assert abs(found.share - s) < 0.01 and abs(found.share - share) < 0.03
    for v, a, b in zip(names, on_good, on_bad):
        assert abs(found.on_good[v] - p[v]) < 0.005 and abs(found.on_bad[v] - q[v]) < 0.01
        assert abs(found.on_good[v] - a) < 0.03 and abs(found.on_bad[v] - b) < 0.06
    lone = spark.createDataFrame([(1, 1, -1, 1)], names).select(found.posterior().alias("p")).first()["p"]
    assert lone > 0.5
