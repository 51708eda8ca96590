"""Integrity, percentiles and batches against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from docgauge.operators import benchmark, integrity, retrieval


def test_hash_tree_names_what_changed(spark):
    rows = [(i, f"text {i}", None if i % 5 else "x") for i in range(400)] + [(None, "nothing", "x"), (7, "text 7", None)]
    before = spark.createDataFrame(rows, "id int, text string, note string")
    after = spark.createDataFrame([r for r in rows if r[0] != 3] + [(900, "new", ""), (5, "text 5", "x")], "id int, text string, note string").withColumn("text", F.when(F.col("id") == 11, None).otherwise(F.col("text")))
    changes = {(r["id"], r["change"]) for r in integrity.changed_rows(before, after, ["id"], depth=6).collect()}
    assert changes == {(3, "removed"), (900, "added"), (5, "changed"), (11, "changed")}
    same = integrity.hash_tree(before.repartition(7).select("note", "text", "id"), ["id"], 6)
    tree = integrity.hash_tree(before, ["id"], 6)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, tree.collect()))
    nodes = integrity.changed_nodes(tree, integrity.hash_tree(after, ["id"], 6)).collect()
    assert {n["level"] for n in nodes} == set(range(7)) and len([n for n in nodes if n["level"] == 6]) <= 4
    assert integrity.changed_rows(before, before, ["id"]).collect() == []
    assert {r["change"] for r in integrity.changed_rows(before, before.limit(0), ["id"]).collect()} == {"removed"}
    nulls = spark.createDataFrame([(None, "other", "x")], "id int, text string, note string")
    assert [tuple(r) for r in integrity.changed_rows(spark.createDataFrame(rows[400:401], "id int, text string, note string"), nulls, ["id"]).collect()] == [(None, "changed")]


def test_rows_told_apart_by_nulls(spark):
    schema = "id int, a string, b string"
    one, other = spark.createDataFrame([(1, None, "x")], schema), spark.createDataFrame([(1, "x", None)], schema)
    empty = spark.createDataFrame([(1, "", "x")], schema)
    assert integrity.changed_rows(one, other, ["id"]).count() == 1 and integrity.changed_rows(one, empty, ["id"]).count() == 1


def test_percentiles_equal_numpy(spark):
    draw = random.Random(3)
    groups = {"hot": [draw.randrange(50) for _ in range(3000)], "one": [4], "two": [1, 10], None: [draw.random() for _ in range(77)], "none": [None]}
    rows = spark.createDataFrame([(k, float(v) if v is not None else None) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r["k"]: r for r in benchmark.percentiles(rows, ["k"], "v", {"p0": 0.0, "p37": 0.37, "p95": 0.95, "p100": 1.0}).collect()}
    assert set(found) == {"hot", "one", "two", None}
    for k, r in found.items():
        np.testing.assert_allclose(r[1:], np.percentile(groups[k], [0, 37, 95, 100]), rtol=1e-12)


def brute_batches(sizes, limit):
    out, batch, held = [], 0, 0
    for s in sizes:
        if held > 0 and held + s > limit:
            batch, held = batch + 1, 0
        out.append(batch)
        held += s
    return out


def test_batches_equal_brute_force(spark):
    draw = random.Random(8)
    for _ in range(300):
        sizes, limit = [draw.randint(1, 12) for _ in range(draw.randint(1, 40))], draw.randint(1, 30)
        starts = retrieval.batch_starts(np.array(sizes), limit)
        assert [sum(s <= i for s in starts) - 1 for i in range(len(sizes))] == brute_batches(sizes, limit)
    texts = [("a", "b1", "x" * 950), ("a", "b2", ""), ("a", "b3", "y" * 2300), ("c", "b1", "")]
    cut = retrieval.segments(spark.createDataFrame(texts, "case_id string, block_id string, text string"), 1000)
    found = retrieval.batches(cut, ["case_id"], ["block_id", "segment_at"], 2000).collect()
    assert found[0].__fields__ == [*cut.columns, "batch"]
    by_case = {}
    for r in sorted(found, key=lambda r: (r["case_id"], r["block_id"], r["segment_at"])):
        by_case.setdefault(r["case_id"], []).append((len(r["segment"]) + 182, r["batch"]))
    for rows in by_case.values():
        assert [b for _, b in rows] == brute_batches([s for s, _ in rows], 2000)
    # 200 000 segments of one case, in one pass
    many = retrieval.batch_starts(np.full(200_000, 300), 4000)
    assert len(many) == -(-200_000 // 13)
