"""Whitening against a full eigendecomposition, and its sums against whole numbers of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.llm import whitening
from docgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(vectors, components=4):
    """{vec_id: [(n, deviation, |whitened|...)]} by numpy and whole numbers."""
    rows = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows]
    distinct = sorted({tuple(x) for _, x in whole})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array(sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    out = []
    for i, x in whole:
        w = np.abs((np.array(x) - np.array(sums) / n) @ turn) / np.sqrt(values)
        out += [(i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w[k], values[k] / np.trace(centred.T @ centred / n)) for k in range(len(values))]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def made(df):
    rows = [(r["vec_id"], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def same(found, wanted):
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in wanted], rtol=1e-7, atol=1e-8)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_query_equals_brute_force(spark, table):
    found = QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint"
    same(made(found), brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    error = {r[0] for r in found.select("identity_error").distinct().collect()}
    assert len(error) == 1 and error.pop() < 1e-10


@pytest.mark.parametrize("beside", [2, 12])
def test_filtered_subspace_of_a_close_spectrum(spark, beside, monkeypatch):
    """Rows of a nearly flat spectrum, many directions beside the block: vectors still come to double precision."""
    monkeypatch.setattr(whitening, "BESIDE", beside)
    draw = np.random.default_rng(5)
    data = [(i, [float(c) for c in row]) for i, row in enumerate(draw.standard_normal((400, 40)) * np.linspace(2.2, 1, 40))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    fit = df.select(whitening.whole_vectors(F.col("embedding")).alias("x"))
    found = whitening.fit_components(fit, 40)
    assert found.passes > 3 and (found.residuals <= whitening.ROUNDED * found.variances[0]).all()
    same(made(whitening.whitened(df)), brute(data))


ODD = [
    (1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [1.001, 2.0, 0.5]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]),
    (None, [-3.0, 0.25, 8.0]), (8, [0.0, -0.0, 0.0]), (9, [1.0, 2.0]), (10, [1e30, 0.0, 0.0]), (11, [5.0, -2.0, 1.0]), (12, [-1.0, 4.0, 2.0]),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    usable = [(i, v) for i, v in ODD if v and len(v) == 3 and i != 10]
    same(made(whitening.whitened(df)), brute(usable, 3))
    clashing = df.select("*", *[F.lit("clash").alias(c) for c in ("x", "i", "n", "high", "low", "at", "v", "w0", "component", "dim")])
    same(made(whitening.whitened(clashing)), brute(usable, 3))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 20


def test_deviation_is_exact_at_any_size():
    x = np.array([[2**40, -(2**40), 3], [1, 2, 3]], "int64")
    for n, sums in ((3, [5, 6, 7]), (10**9, [2**62, -(2**50), 11])):
        assert whitening._exact_deviation(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
